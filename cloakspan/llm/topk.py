"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its dimensions are terms, its non-zero components
integer weights.  Queries and candidates are dealt into blocks of bounded size, equal
rows too; every pair of a query block and a candidate block is one cell.  A cell
walks its candidates in strips, which become postings (term to rows and weights).
For one term after the other, the queries that hold it scatter their weight times
the postings into dense score arrays; partition selection takes each query's best,
which are merged with the best of the strips before.  The cells' winners are
merged by rank.

Posting lists that cover a quarter of their block or more are held as dense
arrays, so that adding them needs no index.

Defined cases: vectors that are null or hold a null or a non-finite component
take no part, nor do rows without an id; an empty vector scores 0 with
everything; shorter vectors lack their last terms.  Every repeated row is a
candidate, but none is one for a query of the same id; of a repeated query id
every row asks, and the answers share the id's ranks.  Scores are exact while
they fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.staging import stage

#: Rows of a candidate block and of a query block; candidates and queries scored
#: at once.
CANDIDATES, QUERIES, STRIP, AT_ONCE = 8_192, 2_048, 2_048, 256
DENSE_SHARE = 0.25


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id`` and ``weights``: each component as floor(scale * component)."""
    finite = F.expr(
        f"forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) "
        "AND abs(x) < double('infinity'))"
    )
    weights = F.expr(f"transform(`{vector}`, x -> floor({scale} * cast(x AS double)))")
    return df.where(finite & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), weights.cast("array<bigint>").alias("weights")
    )


def _postings(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every non-zero component."""
    lists = rows.combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    held = flat != 0
    return row[held], term[held], flat[held]


def _by_term(row, term, weight) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    rows, weights = np.split(row[order], starts[1:]), np.split(weight[order], starts[1:])
    return {int(t): (r, w) for t, r, w in zip(terms, rows, weights)}


def best_of_cell(
    query_ids: np.ndarray, queries, ids: np.ndarray, candidates, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's ``k`` best in a cell; ``ids``
    ascend, ``queries`` and ``candidates`` are (row, term, weight)."""
    size = len(ids)
    q_row, q_term, q_weight = queries
    c_row, c_term, c_weight = candidates
    if not size or not len(query_ids):
        return query_ids[:0], ids[:0], ids[:0]
    terms = int(max(q_term.max(initial=-1), c_term.max(initial=-1))) + 1
    bound = (
        float(np.abs(q_weight).max(initial=0))
        * float(np.abs(c_weight).max(initial=0))
        * max(1, terms)
    )
    kind = np.int32 if bound < 2**31 else np.int64
    dense = {}
    postings = _by_term(c_row, c_term, c_weight.astype(kind))
    for term, (rows, weights) in postings.items():
        if len(rows) >= DENSE_SHARE * size:
            dense[term] = np.zeros(size, dtype=kind)
            dense[term][rows] = weights
    found_q, found_c, found_s = [], [], []
    take = min(k, size)
    for at in range(0, len(query_ids), AT_ONCE):
        own = query_ids[at : at + AT_ONCE]
        part = (q_row >= at) & (q_row < at + AT_ONCE)
        scores = np.zeros((len(own), size), dtype=kind)
        for term, (q, w) in _by_term(
            q_row[part] - at, q_term[part], q_weight[part].astype(kind)
        ).items():
            if term in dense:
                scores[q] += w[:, None] * dense[term]
            elif term in postings:
                rows, weights = postings[term]
                scores[q[:, None], rows] += w[:, None] * weights
        is_own = own[:, None] == ids
        if bound * size < 2**62:  # one number ranks by score, then by id
            rank = scores.astype(np.int64) * size + np.arange(size - 1, -1, -1)
            rank[is_own] = np.iinfo(np.int64).min
            if take < size:
                best = np.argpartition(rank, size - take, axis=1)[:, size - take :]
            else:
                best = np.broadcast_to(np.arange(size), rank.shape)
        else:
            worst = np.where(is_own, 1, 0)
            best = np.array(
                [np.lexsort((ids, ~s, o))[:take] for s, o in zip(scores, worst)]
            )
        row = np.repeat(np.arange(len(own)), best.shape[1])
        column = best.ravel()
        kept = ~is_own[row, column]
        found_q.append(own[row[kept]])
        found_c.append(ids[column[kept]])
        found_s.append(scores[row[kept], column[kept]].astype(np.int64))
    return np.concatenate(found_q), np.concatenate(found_c), np.concatenate(found_s)


def best_of_ids(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int):
    """The ``k`` best of each query id, ties to the smaller candidate."""
    order = np.lexsort((c, ~s, q))
    q, c, s = q[order], c[order], s[order]
    at = np.arange(len(q))
    kept = at - np.searchsorted(q, q) < k
    return q[kept], c[kept], s[kept]


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """For each query among ``vectors`` (``id``, ``weights``): ``query_id``,
    ``rank``, ``vec_id``, ``score`` of the ``k`` best other rows, ties to the
    smaller id.

    The work is the product of queries and rows, as asked.  A cell's input
    has a fixed size; only winners are shuffled afterwards.
    """
    # staged, so that a task run again finds every row at the same place
    vectors = stage(vectors.withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    queries = vectors.where("asks")
    total, asked = vectors.agg(F.count("*"), F.count_if("asks")).first()
    across, down = -(-total // CANDIDATES) or 1, -(-asked // QUERIES) or 1

    def dealt(df: DataFrame, own: int, other: int, query: bool) -> DataFrame:
        # by the place of a row too, or equal rows would share a block
        block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(own))
        cell = "block * {0} + other" if not query else "other * {0} + block"
        # a row's block comes first: all its copies have it
        copies = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return (
            df.withColumn("block", block)
            .withColumn("other", copies)
            .select(F.expr(cell.format(down)).alias("cell"), F.lit(query).alias("query"), "id", "weights")
        )

    cells = dealt(vectors, across, down, False).union(dealt(queries, down, across, True))

    def score(cell: pa.Table) -> pa.Table:
        asks = cell.column("query").to_numpy(zero_copy_only=False).astype(bool)
        cell = cell.select(["id", "weights"])
        held = cell.filter(pa.array(~asks)).sort_by("id")
        asking = cell.filter(pa.array(asks))
        query_ids = asking.column("id").to_numpy()
        queries, best = _postings(asking.column("weights")), None
        for at in range(0, len(held), STRIP):
            strip = held.slice(at, STRIP)
            ids = strip.column("id").to_numpy()
            found = best_of_cell(query_ids, queries, ids, _postings(strip.column("weights")), k)
            if best is not None:
                found = tuple(map(np.concatenate, zip(best, found)))
            best = best_of_ids(*found, k)
        q, c, s = best or (query_ids[:0],) * 3
        return pa.table({"query_id": q, "vec_id": c, "score": s})

    winners = cells.groupBy("cell").applyInArrow(
        score, "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        winners.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
