"""Quality: Bradley-Terry pairwise ranking of documents.

A document is a vector of measures of its whole text.  Preference pairs put a
labelled good document over a labelled bad one; logistic loss on the
difference of their vectors gives the weights of a score.  The weights are
fitted on a bounded sample.  The decision cuts the scores of all labelled
documents that are not held out at a quantile: the share of bad ones among them.
The reported score is the logistic of the distance to that cut, shifted so that
the cut stands at 0.7.

Defined cases: null and empty texts have the vector of an empty text; repeated
rows are scored each; without labelled rows of both classes every document
scores 0.7 (nothing speaks against it).
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspan.functions.staging import scratch, stage

from .learning import fit_logistic, is_held_out, known_labels, labelled_sample, sigmoid

#: Labelled documents of each class learned from; bad ones met by each good one.
PER_CLASS, RIVALS = 4_000, 8
CUT = 0.7
#: Bins of a histogram of scores, and the scores the driver sorts itself.
BINS, FEW = 4_096, 10_000

MEASURES = (
    "log_chars", "log_words", "letters", "upper", "digits", "marks", "symbols",
    "spaces", "mark_runs", "word_length", "long_words", "distinct_words",
    "top_word", "repeated_next", "repeated_lines", "repeated_threes",
    "line_length", "short_lines", "entropy", "capital_words", "ends_of_sentence",
)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point up to U+FFFF: 0 other, 1 lower-case or caseless
    letter, 2 upper-case letter, 3 digit, 4 punctuation, 5 symbol, 6 space."""
    kinds = {"Lu": 2, "Lt": 2, "Zs": 6, "Cc": 6}
    first = {"L": 1, "N": 3, "P": 4, "S": 5}
    names = [unicodedata.category(chr(c)) for c in range(1 << 16)]
    return np.array([kinds.get(n, first.get(n[0], 0)) for n in names], dtype=np.uint8)


def measures(text: str | None) -> np.ndarray:
    """The vector of a text, in the order of MEASURES."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.minimum(points, 0xFFFF)
    kinds = _classes()[points]
    n = max(1, len(points))
    count = np.bincount(kinds, minlength=7)
    letters = count[1] + count[2]
    unlike = (kinds == 4) | (kinds == 5)
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    spaces = max(1, count[6])
    lines = [line for line in text.split("\n") if line.strip()]
    k = max(1, len(lines))
    threes = len(set(zip(words, words[1:], words[2:])))
    frequent = np.bincount(points)
    frequent = frequent[frequent > 0] / n
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.array(
        [
            np.log1p(len(points)),
            np.log1p(len(words)),
            letters / n,
            count[2] / max(1, letters),
            count[3] / n,
            count[4] / n,
            count[5] / n,
            spaces / n,
            np.count_nonzero(unlike[1:] & unlike[:-1]) / m,
            lengths.mean() if words else 0.0,
            np.count_nonzero(lengths > 15) / m,
            len(seen) / m,
            max(seen.values(), default=0) / m,
            sum(map(str.__eq__, words, words[1:])) / m,
            1 - len(set(lines)) / k if lines else 0.0,
            1 - threes / max(1, len(words) - 2) if len(words) > 2 else 0.0,
            np.log1p(len(points) / k),
            sum(len(line) < 30 for line in lines) / k,
            -float((frequent * np.log(frequent)).sum()) if len(points) else 0.0,
            sum(map(str.istitle, words)) / m,
            sum(map(str.endswith, words, [(".", "!", "?")] * len(words))) / m,
        ]
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    steepness: float

    def strength(self, vectors: np.ndarray) -> np.ndarray:
        """The Bradley-Terry score of each row of measures."""
        return np.clip((vectors - self.mean) / self.scale, -6, 6) @ self.weight

    def score(self, vectors: np.ndarray) -> np.ndarray:
        above = (self.strength(vectors) - self.cut) * self.steepness
        return sigmoid(above + np.log(CUT / (1 - CUT)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    per_class: int = PER_CLASS,
    rivals: int = RIVALS,
) -> Model:
    """Weights from at most ``per_class`` labelled documents a class, and the
    cut from all that may be learned from."""
    with scratch(docs.sparkSession):
        sample, share = labelled_sample(docs, labels, label, per_class, key)
        good, bad = _measured(sample, key)
        model = _ranked(good, bad, rivals)
        if not len(good) or not len(bad):
            return model
        known = known_labels(labels, label, key)
        strengths = stage(_strengths(docs, known, model, key), "strengths")
        return replace(model, cut=_quantile(strengths, 1 - share))


def _measured(sample: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the good and of the bad documents, in the order of ids."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            found = [measures(texts[i].as_py()).tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), pa.array(found, pa.binary())],
                ["key", "label", "vector"],
            )

    kind = sample.schema[key].dataType.simpleString()
    rows = (
        sample.select("text", "label", key)
        .mapInArrow(measure, f"key {kind}, label int, vector binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["key"], r["vector"]))
    width = len(MEASURES)
    vectors = np.array([np.frombuffer(r["vector"]) for r in rows]).reshape(-1, width)
    classes = np.array([r["label"] for r in rows])
    return vectors[classes == 1], vectors[classes == 0]


def _ranked(good: np.ndarray, bad: np.ndarray, rivals: int) -> Model:
    """The Bradley-Terry model of pairs of a good and a bad document, cut at 0."""
    width = len(MEASURES)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    mean = (good.mean(axis=0) + bad.mean(axis=0)) / 2
    scale = np.sqrt((good.var(axis=0) + bad.var(axis=0)) / 2) + 1e-3
    unit = lambda x: np.clip((x - mean) / scale, -6, 6)

    # each good document meets some bad ones, at strides that do not repeat
    winners = np.repeat(np.arange(len(good)), rivals)
    met = winners * 7919 + np.tile(np.arange(rivals) * 104_729, len(good))
    difference = unit(good)[winners] - unit(bad)[met % len(bad)]
    flat = np.tile(np.arange(width), len(difference))
    both = np.concatenate((difference, -difference))  # either order: no intercept
    weight, _ = fit_logistic(
        np.repeat(np.arange(len(both)), width),
        np.concatenate((flat, flat)),
        both.ravel(),
        np.repeat([1.0, 0.0], len(difference)),
        width,
        penalty=1e-4,
        steps=250,
    )

    return Model(mean, scale, weight, 0.0, 1.0)


def _strengths(docs: DataFrame, known: DataFrame, model: Model, key: str) -> DataFrame:
    """``strength`` of each document in ``known``; of one given twice the
    smaller.  Texts are measured where they are and not shuffled."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            vectors = [measures(texts[i].as_py()) for i in range(len(texts))]
            found = model.strength(np.array(vectors).reshape(-1, len(MEASURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64())], [key, "strength"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(key, "text")
        .where(F.col(key).isNotNull() & ~is_held_out(key))
        .mapInArrow(compute, f"`{key}` {kind}, strength double")
        .groupBy(key)
        .agg(F.min("strength").alias("strength"))
        .join(known.select(key), key)
        .select("strength")
    )


def _quantile(strengths: DataFrame, share: float) -> float:
    """The middle between the last strength of the lowest ``share`` and the next."""
    n = strengths.count()
    rank = min(max(ceil(share * n - 1e-9), 1), n - 1)
    return (_of_rank(strengths, rank) + _of_rank(strengths, rank + 1)) / 2


def _of_rank(strengths: DataFrame, rank: int) -> float:
    """The strength of a rank from 1, exactly.  Histograms are summed before the
    shuffle and narrowed down to a bin that the driver can sort."""
    value = F.col("strength")
    shape = [F.count("*").alias("many"), F.min(value).alias("low"), F.max(value).alias("high")]
    within = strengths.agg(*shape).first()
    while within["many"] > FEW and within["low"] < within["high"]:
        low, high = within["low"], within["high"]
        strengths = strengths.where(value.between(low, high))
        bin_of = F.least(F.floor((value - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        for within in sorted(strengths.groupBy(bin_of).agg(*shape).collect(), key=lambda r: r["low"]):
            if rank <= within["many"]:
                break
            rank -= within["many"]
    if within["low"] == within["high"]:
        return within["low"]
    rows = strengths.where(value.between(within["low"], within["high"])).collect()
    return sorted(r["strength"] for r in rows)[rank - 1]


def score(df: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, ``held_out``, ``score`` and ``predicted``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            vectors = [measures(texts[i].as_py()) for i in range(len(texts))]
            scores = model.score(np.array(vectors).reshape(-1, len(MEASURES)))
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
            (F.col("score") >= CUT).cast("int").alias("predicted"),
        )
    )


def keep(df: DataFrame, model: Model, text: str = "text", least: float = CUT) -> DataFrame:
    """The rows of ``df`` whose score is ``least`` or more, with its columns as
    they are; one narrow pass."""
    at = df.columns.index(text)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            vectors = [measures(texts[i].as_py()) for i in range(len(texts))]
            scores = model.score(np.array(vectors).reshape(-1, len(MEASURES)))
            yield batch.filter(pa.array(scores >= least))

    return df.mapInArrow(choose, df.schema)
