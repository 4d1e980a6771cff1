"""URL filter: rules first, then logistic regression on character n-grams.

A URL's host and path are read by fixed rules of their own.  A rule names a
verdict, a host and a path; it fits its host and all subdomains where the path
begins with the rule's, and the longest fitting rule decides.  URLs without a rule get
the verdict of a logistic regression on hashed character n-grams of host and
path (the two hashed apart), trained from a small table of labelled URLs.

Defined cases: a null URL, or one without ``://``, has an empty host and path, which no
rule fits, and the verdict of the model's intercept; repeated rows are judged
each; without labelled URLs of both verdicts the model allows everything that
it has only seen allowed (or nothing seen), else blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import fit_logistic, sigmoid
from .ngrams import buckets

SIZES = (3, 4, 5)
BITS = 16
#: Labelled URLs of each verdict learned from.
PER_VERDICT = 5_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    found = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    return F.when(at > 0, found).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule) -> Column:
    host = F.concat(F.lit("."), F.col("host"))
    return host.endswith("." + rule.host) & F.col("path").startswith(rule.path)


def with_rule(df: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``rule_verdict``; columns of
    these names are replaced.  The rules are a short list of settings."""
    df = df.withColumns({"host": host_of(url), "path": path_of(url)})
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        name = F.when(_fits(rule), rule.name).otherwise(name)
        verdict = F.when(_fits(rule), rule.verdict).otherwise(verdict)
    return df.withColumns({"rule": name, "rule_verdict": verdict})


def features(host: str, path: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of the n-grams of a host and a path."""
    parts = [*buckets(f"\x02{host}\x03", sizes, bits), *buckets(f"\x04{path}\x05", sizes, bits)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    intercept: float
    sizes: tuple[int, ...]
    bits: int

    def score(self, host: str, path: str) -> float:
        """How likely the URL is one to block."""
        found = features(host, path, self.sizes, self.bits)
        return float(sigmoid(self.intercept + self.weight[found].sum()))


def train(
    labelled: DataFrame,
    per_verdict: int = PER_VERDICT,
    sizes: tuple[int, ...] = SIZES,
    bits: int = BITS,
) -> Model:
    """From a table (``host``, ``path``, ``verdict``); of each verdict the
    distinct rows that hash lowest, at most ``per_verdict``."""
    rows = []
    for verdict in ("allow", "block"):
        rows += (
            labelled.where(F.col("verdict") == verdict)
            .select("host", "path", "verdict")
            .distinct()
            .orderBy(F.xxhash64("host", "path"), "host", "path")
            .limit(per_verdict)
            .collect()
        )
    found = [features(r["host"], r["path"], sizes, bits) for r in rows]
    targets = np.array([r["verdict"] == "block" for r in rows], dtype=float)
    if len(set(targets)) < 2:
        only = 10.0 if len(targets) and targets[0] else -10.0
        return Model(np.zeros(1 << bits), only, sizes, bits)
    columns = np.concatenate(found)
    weight, intercept = fit_logistic(
        np.repeat(np.arange(len(found)), [len(f) for f in found]),
        columns,
        np.ones(len(columns)),
        targets,
        1 << bits,
        penalty=1e-5,
        steps=100,
        rate=0.02,
    )
    return Model(weight.astype(np.float32), intercept, sizes, bits)


def judge(
    df: DataFrame, rules: Sequence[Rule], model: Model, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """Per row: ``key``, ``host``, ``path``, ``rule``, ``verdict`` and the
    model's ``score`` (1: block).  One narrow pass."""
    named = with_rule(df.select(key, url), rules, url)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            scores = [model.score(h, p) for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())],
                [key, "host", "path", "rule", "rule_verdict", "score"],
            )

    kind = df.schema[key].dataType.simpleString()
    return (
        named.select(key, "host", "path", "rule", "rule_verdict")
        .mapInArrow(
            score,
            f"`{key}` {kind}, host string, path string, rule string, "
            "rule_verdict string, score double",
        )
        .select(
            key, "host", "path", "rule",
            F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
            "score",
        )
    )
