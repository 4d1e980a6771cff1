"""Shards of near-equal bytes, tokens and rows, by vector bin packing.

A group (rows of equal text) is a vector of bytes, tokens and rows.  Groups are
taken from large to small, and each is placed in the shard whose residual capacity,
what is still missing to a sixteenth of the whole, has the highest dot product with
the group's vector; both are in units of the whole.  Bytes weigh most, as they are
what has to come out near equal (the law is `bytes`).

* Heavy groups, those with more than 1/256 of a shard in any dimension, are placed
  first and one after another.  Their number is bounded by 3 * 256 for each shard,
  however large the table, so the driver places them.  A group of many copies is
  cut into pieces of about that size first; without the cut a text that fills a
  third of the table would fill a shard several times over.
* All others are dealt into packs by a hash of their text, of a bounded number of
  groups.  Each pack is placed in a task of its own, group by group, against the
  pack's share of what the heavy groups have left of every shard.

A shard misses its sixteenth by what the last and smallest groups of the packs leave
over, unless a single document is larger than a shard.  Slots count a shard's rows
inside the blocks in which the rows were staged, on top of the blocks before.

Defined cases: null texts have no bytes and no tokens, so they form one group with empty
texts; repeated rows and rows with null or repeated ids are rows like any other; ties go
to the lower shard; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakspan.functions.staging import stage

SHARDS = 16
#: A group is heavy above this part of a shard, in any dimension.
HEAVY = 1 / 256
#: Groups of a pack, about.
PACK = 1_024
#: What bytes, tokens and rows count in the dot product.
WEIGHTS = (16.0, 1.0, 1.0)

DIMENSIONS = ("bytes", "tokens", "rows")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, size, text_crc32, tokens``, the text's ``digest``, and
    ``row_no``, which is unique and stays as it is once the rows are staged."""
    plain = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return plain.select(
        "doc_id",
        (F.octet_length("text") + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long").alias("tokens"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector.  ``residual`` (shards x dimensions, in the units
    of the vectors) is reduced in place."""
    placed = np.zeros(len(vectors), dtype=np.int32)
    weighted = vectors * np.array(WEIGHTS)
    for at in np.argsort(-vectors.max(axis=1), kind="stable"):
        shard = int(np.argmax(residual @ weighted[at]))
        residual[shard] -= vectors[at]
        placed[at] = shard
    return placed


def _heavy_placed(
    rows: DataFrame, heavy: DataFrame, total: np.ndarray, shards: int
) -> tuple[list[tuple], np.ndarray]:
    """(digest, piece, shard) of heavy groups' pieces, and the capacity left."""
    pieces = rows.join(F.broadcast(heavy), "digest").withColumn("piece", _piece("pieces"))
    counted = (
        pieces.groupBy("digest", "piece")
        .agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
        .collect()
    )
    counted = sorted(counted, key=lambda r: (bytes(r["digest"]), r["piece"]))
    residual = np.full((shards, len(total)), 1 / shards)
    vectors = np.array([[r[d] for d in DIMENSIONS] for r in counted], dtype=float).reshape(-1, len(total))
    placed = place(vectors / total, residual)
    return [(r["digest"], r["piece"], int(s)) for r, s in zip(counted, placed)], residual


def _piece(pieces: str) -> Column:
    return F.pmod(F.xxhash64("row_no"), F.col(pieces)).cast("int")


def _packed(light: DataFrame, packs: int, residual: np.ndarray) -> DataFrame:
    """(digest, shard) of the light groups."""
    free = np.maximum(residual, 0)
    share = free / np.maximum(free.sum(axis=0), 1e-300)

    def pack(table: pa.Table) -> pa.Table:
        digests = table.column("digest")
        order = np.argsort(np.array(digests.to_pylist(), dtype=object), kind="stable")
        vectors = np.stack(
            [table.column(d).to_numpy().astype(float) for d in DIMENSIONS], axis=1
        )[order]
        vectors /= np.maximum(vectors.sum(axis=0), 1)
        shard = np.empty(len(order), dtype=np.int32)
        shard[order] = place(vectors, share.copy())
        return pa.table({"digest": digests, "shard": pa.array(shard)})

    return (
        light.withColumn("pack", F.pmod(F.xxhash64("digest"), F.lit(packs)))
        .groupBy("pack")
        .applyInArrow(pack, "digest binary, shard int")
    )


def _slots(placed: DataFrame) -> DataFrame:
    """``slot`` counts the rows of a shard from 0, by staged block and row."""
    placed = placed.withColumn("block", F.shiftright("row_no", 33))
    within = Window.partitionBy("shard", "block").orderBy("row_no")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "block")
        .count()
        .select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    return (
        placed.withColumn("within", F.row_number().over(within))
        .join(offsets, ["shard", "block"])
        .withColumn("slot", (F.col("offset") + F.col("within") - 1).cast("long"))
    )


def shard(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    heavy: float = HEAVY,
    pack: int = PACK,
) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and
    ``tokens``."""
    rows = stage(measured(docs, key, text), "measured")
    totals = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    total = np.array([max(1, x or 0) for x in totals], dtype=float)

    groups = stage(
        rows.groupBy("digest").agg(
            F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
        ),
        "text-groups",
    )
    parts = F.greatest(*(F.col(d) * F.lit(shards / (heavy * t)) for d, t in zip(DIMENSIONS, total)))
    weighed = groups.withColumn("weight", parts)
    large = weighed.where("weight > 1").select(
        "digest", F.least("rows", F.ceil("weight")).alias("pieces")
    )
    # at most len(DIMENSIONS) * shards / heavy groups can be that large
    units, residual = _heavy_placed(rows, large, total, shards)
    light = weighed.where("weight <= 1")
    packs = max(1, -(-light.count() // pack))
    packed = _packed(light.select("digest", *DIMENSIONS), packs, residual)

    spark = docs.sparkSession
    known = spark.createDataFrame(units, "digest binary, piece int, shard int")
    columns = ["doc_id", "size", "text_crc32", "tokens", "row_no", "shard"]
    marked = rows.join(F.broadcast(large), "digest", "left")
    of_heavy = (
        marked.where("pieces IS NOT NULL")
        .withColumn("piece", _piece("pieces"))
        .join(F.broadcast(known), ["digest", "piece"])
    )
    of_light = marked.where("pieces IS NULL").join(packed, "digest")
    placed = of_light.select(columns).union(of_heavy.select(columns))
    return _slots(stage(placed, "placed")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
