"""Joins of many rows with unique ones, where a key may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

# Rows of one key that a single join partition takes.
ROWS_PER_PART = 250_000


def join_unique(
    rows: DataFrame,
    unique: DataFrame,
    on: list[str],
    spread: list[str],
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """``rows.join(unique, on)`` for a ``unique`` that holds each key once.

    Keys with more than ``rows_per_part`` rows are cut into parts by a hash of
    the columns ``spread``, and their unique row is repeated for each part.  The
    counts are summed before they are shuffled; there are at most as many hot keys
    as ``rows`` holds parts.  Stage ``rows`` first: it is read twice.
    """
    parts = F.ceil(F.col("count") / rows_per_part).cast("int")
    hot = rows.groupBy(*on).count().where(F.col("count") > rows_per_part)
    hot = stage(hot.select(*on, parts.alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(unique, on)
    count = F.coalesce("_parts", F.lit(1))
    part = F.pmod(F.xxhash64(*spread), count).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    repeated = (
        unique.join(hot, on, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), count - 1)))
        .drop("_parts")
    )
    return dealt.join(repeated, [*on, "_part"]).drop("_part")
