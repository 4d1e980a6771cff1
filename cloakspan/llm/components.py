"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspan.functions.staging import stage


def _marks(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(a % 65536)")
        ).first()
    )


def _to_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least value ``m`` among u and its partners.

    The minimum is aggregated before the shuffle; the join's hot nodes are
    left to adaptive skew handling.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.withColumn("m", F.least("u", "m")), "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node that can be reached) for
    each node of the edges.

    Each round hangs every larger partner of a node to its smallest one (large
    star), then every smaller partner and the node itself (small star), until
    nothing moves; a number of rounds that grows with the logarithm of the
    nodes.  Every round is written to the shared folder.  Edges with a null
    and loops are ignored; an empty table gives no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = stage(edges.where("a <> b").distinct(), "edges")
    before = _marks(edges)
    while before[0]:
        both = edges.selectExpr("a AS u", "b AS v").union(
            edges.selectExpr("b AS u", "a AS v")
        )
        large = _to_least(both).where("v > u").selectExpr("v AS u", "m AS v").distinct()
        small = _to_least(large)
        hung = small.selectExpr("u AS a", "m AS b").union(
            small.where("v <> m").selectExpr("v AS a", "m AS b")
        )
        edges = stage(hung.distinct(), "edges")
        after = _marks(edges)
        if after == before:
            break
        before = after
    whole = edges.selectExpr("a AS node", "b AS component")
    roots = edges.selectExpr("b AS node", "b AS component").distinct()
    return whole.union(roots)
