"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes.

Each document is the set of its hashed character n-grams.  From a bounded
sample of labelled documents, every n-gram gets the logarithm of the ratio of
its (smoothed) frequencies in the two classes.  The n-grams whose ratio is
farthest from chance, in standard errors, are kept; a logistic regression on
"present: its ratio, absent: 0" gives the final weights.

Defined cases: null and empty texts have no n-gram and the score of the
intercept; repeated rows are scored each; without labelled rows of both
classes every score is the share of class 1 (0 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspan.functions.staging import scratch

from .learning import fit_logistic, is_held_out, labelled_sample, sigmoid
from .ngrams import buckets

SIZES = (4, 5, 6)
BITS = 20
#: Labelled documents of each class learned from, and n-grams kept.
PER_CLASS, KEPT = 4_000, 4_000


@dataclass(frozen=True)
class Model:
    slot: np.ndarray  # bucket to kept n-gram, -1: none
    weight: np.ndarray
    intercept: float
    sizes: tuple[int, ...]
    bits: int

    def present(self, text: str | None) -> np.ndarray:
        """The kept n-grams that occur in a text."""
        return present(text, self.slot, self.sizes, self.bits)

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.intercept + self.weight[self.present(text)].sum()))


def _prepared(text: str | None) -> str:
    return f" {text.lower()} " if text else ""


def present(text: str | None, slot: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    found = []
    for part in buckets(_prepared(text), sizes, bits):
        slots = slot[part]
        found.append(slots[slots >= 0])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    per_class: int = PER_CLASS,
    kept: int = KEPT,
    sizes: tuple[int, ...] = SIZES,
    bits: int = BITS,
) -> Model:
    """Weights of at most ``kept`` n-grams from at most ``per_class`` labelled
    documents of each class."""
    with scratch(docs.sparkSession):
        sample, share = labelled_sample(docs, labels, label, per_class, key)
        return _trained(sample, share, kept, sizes, bits)


def _trained(
    sample: DataFrame, share: float, kept: int, sizes: tuple[int, ...], bits: int
) -> Model:
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each class that have an n-gram; a row for a task."""
        counts, documents = np.zeros((2, width), dtype=np.int32), [0, 0]
        for batch in batches:
            texts, classes = batch.column(0), batch.column(1).to_pylist()
            for i, c in enumerate(classes):
                documents[c] += 1
                parts = [*buckets(_prepared(texts[i].as_py()), sizes, bits)]
                if parts:
                    counts[c, np.unique(np.concatenate(parts))] += 1
        for c in (0, 1):
            if documents[c]:
                nonzero = np.flatnonzero(counts[c]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.array([c], pa.int32()),
                        "n": pa.array([documents[c]], pa.int64()),
                        "at": pa.array([nonzero.tobytes()], pa.binary()),
                        "many": pa.array([counts[c][nonzero].tobytes()], pa.binary()),
                    }
                )

    counts, documents = np.zeros((2, width)), np.zeros(2)
    schema = "label int, n long, at binary, many binary"
    for r in sample.select("text", "label").mapInArrow(count, schema).toLocalIterator():
        documents[r["label"]] += r["n"]
        counts[r["label"], np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["many"], np.int32)

    slot = np.full(width, -1, dtype=np.int16)
    if not documents.all():
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(slot, np.zeros(1), float(odds), sizes, bits)
    rate = (counts + 0.5) / (documents[:, None] + 1)
    ratio = np.log(rate[1] / (1 - rate[1])) - np.log(rate[0] / (1 - rate[0]))
    error = np.sqrt(
        (1 / (counts + 0.5) + 1 / (documents[:, None] - counts + 0.5)).sum(axis=0)
    )
    order = np.argsort(-np.abs(ratio / error), kind="stable")[:kept]
    slot[order] = np.arange(len(order), dtype=np.int16)
    ratio = ratio[order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            found = [
                present(texts[i].as_py(), slot, sizes, bits).astype(np.int16).tobytes()
                for i in range(len(texts))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(found, pa.binary())], ["label", "slots"]
            )

    learned = sample.select("text", "label").mapInArrow(rows, "label int, slots binary").collect()
    slots = [np.frombuffer(r["slots"], np.int16) for r in learned]
    targets = np.array([r["label"] for r in learned], dtype=float)
    columns = np.concatenate(slots).astype(np.int64)
    weight, intercept = fit_logistic(
        np.repeat(np.arange(len(slots)), [len(s) for s in slots]),
        columns,
        ratio[columns],
        targets,
        len(order),
        weights=np.where(targets == 1, share / documents[1], (1 - share) / documents[0]),
        penalty=1e-3,
    )
    return Model(slot, weight * ratio, intercept, sizes, bits)


def score(df: DataFrame, model: Model, key: str = "doc_id", least: float = 0.3) -> DataFrame:
    """Per row: ``key``, ``held_out``, ``score`` and ``predicted``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            scores = [model.score(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], [key, "score"]
            )

    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(key, "text")
        .mapInArrow(compute, f"`{key}` {kind}, score double")
        .select(
            key,
            is_held_out(key).alias("held_out"),
            "score",
            (F.col("score") >= least).cast("int").alias("predicted"),
        )
    )
