"""Consecutive numbers inside a group of any size, without one task per group.

A plain ``row_number`` over (scope, type) puts all values of a corpus-wide
scope into one task per type.  Here the documents' order is cut into blocks at
quantiles of the rows: rows are ranked inside their block, the block sizes are
summed up, and rank + offset is the number.  The borders are literals of the
plan, so a retried task gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

# Rows wanted in a block, the largest number of blocks, and the rows looked at
# for each border.
ROWS_PER_BLOCK, MOST_BLOCKS, SAMPLE_EACH = 50_000, 4_096, 8
UNITS_PER_BLOCK = 1024


def block_borders(rows: DataFrame, order: list[str], rows_per_block: int) -> list:
    """Ascending documents at which a new block begins, for ids of any type.

    They are quantiles of the rows that hash lowest, at most ``MOST_BLOCKS *
    SAMPLE_EACH`` of them.
    """
    blocks = min(MOST_BLOCKS, rows.count() // rows_per_block)
    if blocks < 2:
        return []
    doc = order[0]
    sample = (
        rows.where(F.col(doc).isNotNull())
        .orderBy(F.xxhash64(*order), *order)
        .limit(blocks * SAMPLE_EACH)
        .select(F.sort_array(F.collect_list(doc)).alias("docs"))
        .first()["docs"]
    )
    at = [sample[i * len(sample) // blocks] for i in range(1, blocks)]
    return list(dict.fromkeys(at))


def block_of(value: Column, borders: list) -> Column:
    """How many borders lie at or before a value, by binary search."""
    listed = F.array(*map(F.lit, borders))
    steps = F.sequence(F.lit(1), F.lit(len(borders).bit_length()))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        after = F.get(listed, middle) <= value
        return F.when(
            after, F.struct((middle + 1).alias("low"), acc["high"].alias("high"))
        ).otherwise(F.struct(acc["low"].alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high"))
    return F.aggregate(steps, start, halve, lambda acc: acc["low"])


def number_in_scope(
    rows: DataFrame,
    group: list[str],
    order: tuple[str, str, str] = ("doc_ord", "unit_no", "pos"),
    out: str = "n",
    document_scopes: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
    unit_block: int = UNITS_PER_BLOCK,
) -> DataFrame:
    """Add ``out``: 1, 2, 3 ... per group in (document, unit, position) order.

    The rows shuffle once, by block.  The offsets come from counts, which are
    summed on the map side; only blocks with something in front of them are
    joined back.  ``document_scopes`` says that a group is one document, which
    needs no document blocks.  Stage ``rows`` first: they are read several times.
    """
    doc, unit, pos = order
    borders = [] if document_scopes else block_borders(rows, [*order], rows_per_block)
    value = F.col(unit).cast("long")
    cut = rows.withColumns(
        {
            "_block": block_of(F.col(doc), borders) if borders else F.lit(0),
            "_units": value - F.pmod(value, F.lit(unit_block).cast("long")),
        }
    )
    fine = [*group, "_block", doc, "_units"]
    numbered = cut.withColumn(
        out,
        F.row_number().over(Window.partitionBy(*fine).orderBy(unit, pos)).cast("long"),
    )
    steps = [(fine, [*group, "_block"], [doc, "_units"])]
    if borders:
        steps.append(([*group, "_block"], group, ["_block"]))
    for keys, parent, along in steps:
        numbered = (
            numbered.join(_offsets(cut, keys, parent, along), keys, "left")
            .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
            .drop("_before")
        )
    return numbered.drop("_block", "_units")


def _offsets(
    rows: DataFrame, keys: list[str], parent: list[str], along: list[str]
) -> DataFrame:
    """Rows in front of each block inside its parent, where there are any."""
    before = (
        Window.partitionBy(*parent)
        .orderBy(*along)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    return (
        sizes.withColumn("_before", F.sum("_size").over(before))
        .where(F.col("_before") > 0)
        .drop("_size")
    )


def number_rows(rows: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """Add ``out``: 1, 2, 3 ... over the whole table, without one task for it.

    Rows are sorted by ranges and staged with the number of their range; a row's
    number is its rank there and the sizes of the ranges before.
    """
    placed = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    # one row for each range
    sizes = placed.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        placed.withColumn(out, within)
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_range", "_before")
    )
