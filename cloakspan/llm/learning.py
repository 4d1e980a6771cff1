"""What the trained classifiers share: a bounded sample of labelled rows, and
logistic regression on sparse rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspan.functions.staging import stage


def is_held_out(key: str = "doc_id"):
    """Rows that no classifier learns from."""
    rest = F.crc32(F.col(key).cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def known_labels(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """``key`` and ``label`` of all labelled rows that may be learned from."""
    return (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(key))
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("label"))
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id"
) -> tuple[DataFrame, float]:
    """At most ``per_class`` documents of each class (``key, text, label``),
    and the share of class 1 among all labelled rows that may be learned from.

    A document labelled twice has its larger label, one given twice its smaller
    text; null labels and ids and documents held out are left out.  The sample
    is the rows whose ids hash lowest, so its ids have a fixed bound and are
    broadcast.
    """
    known = known_labels(labels, label, key)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for value in (0, 1):
        lowest = (
            known.where(F.col("label") == value)
            .orderBy(F.xxhash64(key), key)
            .limit(per_class)
        )
        chosen = lowest if chosen is None else chosen.union(lowest)
    texts = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    sample = (
        texts.join(F.broadcast(chosen), key).groupBy(key, "label").agg(F.min("text").alias("text"))
    )
    return stage(sample, "labelled-sample"), share


def fit_logistic(
    rows: np.ndarray,
    columns: np.ndarray,
    values: np.ndarray,
    targets: np.ndarray,
    width: int,
    weights: np.ndarray | None = None,
    penalty: float = 1e-4,
    steps: int = 150,
    rate: float = 0.05,
) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a logistic regression on sparse rows
    (row, column, value), by full-batch Adam steps; deterministic."""
    n = max(1, len(targets))
    weights = np.ones(len(targets)) if weights is None else weights
    weights = weights / max(weights.sum(), 1e-12)
    theta = np.zeros(width + 1)
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        score = theta[width] + np.bincount(rows, theta[columns] * values, minlength=n)[: len(targets)]
        slope = weights * (sigmoid(score) - targets)
        gradient = np.append(
            np.bincount(columns, slope[rows] * values, minlength=width)
            + penalty * theta[:width],
            slope.sum(),
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:width], float(theta[width])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
