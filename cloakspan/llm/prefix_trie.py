"""The prefix trie of conversations, built as a burst trie.

A conversation is a sequence of turns, a turn's id a digest of its role and text.
Every distinct sequence of first turns is a node of the trie.

1. Turns get their places in a sort by ranges, so a conversation of any length is
   spread over tasks.  Equal conversations become one sequence that counts as many.
2. All sequences begin in one container, that of the root.  A container of too many
   bursts: its node becomes a trie head, and each of its sequences moves on to the
   container of its next turn's id.  This is repeated while any container is too large.
3. Containers are dealt to shards by a hash of their heads and sorted by the turns that
   follow.  One sweep over a shard builds all nodes below the containers' heads, with
   a stack as deep as a window.  Heads sum up what their containers report.
4. A container holds a window of so many turns.  Sequences that are still together at
   its end, one that ends there included, make a container of the next window, which is
   built first and reports to this one.  What a single sequence has beyond its window is a chain, of which every
   node is written from its own turn.

Rounds: one for each burst level and one for each window that sequences share in
full, so they grow with the longest prefix shared by many, not with the table.

Defined cases: turns are ordered by number, nulls first, equal numbers by turn id;
repeated rows are repeated turns; null roles and texts are empty; turns without a
conversation's id belong to none and are left out; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakspan.functions.staging import stage

#: Sequences a container may hold, and the most heads of one burst level: larger
#: tables get larger containers.
CONTAINER, MOST_HEADS = 512, 10_000
#: Turns of a sequence that a container looks at.
WINDOW = 256
#: Conversations take over at most so many turns of another one.
MOST_INHERITED = 3
#: Ids of one piece of an end list.
IDS = 4_096

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
_EMPTY = hashlib.sha256(b"").hexdigest()
_SWEPT = pa.schema(
    [("top", pa.bool_()), ("head", pa.binary()), ("at", pa.int32())]
    + [(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _COLUMNS]
    + [("path", pa.list_(pa.struct([("head", pa.binary()), ("words", pa.int32())])))]
)


# ---- turns in their places


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pos`` and ``cum`` (words so far) of each row inside its conversation,
    among the sorted rows of a partition."""
    last, pos, cum = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        words = batch.column("words").to_numpy().astype(np.int64)
        begins = np.concatenate(([conv[0] != last], conv[1:] != conv[:-1]))
        run = np.cumsum(begins)  # 0: goes on with the run of the batch before
        first = np.concatenate(([0], np.flatnonzero(begins)))
        total = np.concatenate(([0], np.cumsum(words)))
        at = first[run]
        place = np.arange(len(conv)) - at + 1 + np.where(run == 0, pos, 0)
        so_far = total[1:] - total[at] + np.where(run == 0, cum, 0)
        last, pos, cum = conv[-1], int(place[-1]), int(so_far[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(place), pa.array(so_far)], [*batch.schema.names, "pos", "cum"]
        )


def numbered(turns: DataFrame) -> DataFrame:
    """Turns as ``conv_id, pos, tid, words, cum``: the place in the conversation
    from 1, the turn's id, and words, also summed up to the turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("tid"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).alias("words"),
    )
    order = ["conv_id", "turn", "tid"]
    placed = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("block"), "conv_id", "tid", "words")
        .mapInArrow(_number, "block int, conv_id long, tid binary, words int, pos long, cum long"),
        "numbered-turns",
    )
    before = (
        Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    # only the first conversation of a block can have begun before it
    carried = (
        placed.groupBy("conv_id", "block")
        .agg(F.max("pos").alias("n"), F.max("cum").alias("w"))
        .select("conv_id", "block", F.sum("n").over(before).alias("n"), F.sum("w").over(before).alias("w"))
        .where("n > 0")
    )
    return placed.join(F.broadcast(carried), ["conv_id", "block"], "left").select(
        "conv_id",
        (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"),
        "tid",
        "words",
        (F.col("cum") + F.coalesce("w", F.lit(0))).alias("cum"),
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """Steps ``conv_id, d, tid, words, cum`` of rebuilt conversations: each takes
    over the first turns of the conversation that begins its twenty.

    Every conversation has a row; rows of ``d`` 0 are no turns.
    """
    own = numbered(turns).withColumn("h", F.expr("crc32(cast(cast(conv_id AS string) AS binary)) % 4"))
    firsts = (
        own.where(f"conv_id % 20 = 0 AND pos <= {MOST_INHERITED}")
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("firsts"))
    )
    info = (
        own.where("pos = 1")
        .selectExpr("conv_id", "h", "conv_id - conv_id % 20 AS base")
        .join(firsts, "base", "left")
        .selectExpr("conv_id", "h", "coalesce(slice(firsts, 1, cast(h AS int)), array()) AS taken")
    )
    info = stage(info, "inherited-turns")
    inherited = info.select("conv_id", F.explode("taken").alias("t")).selectExpr(
        "conv_id", "t.pos AS d", "t.tid", "t.words", "cast(NULL AS long) AS cum"
    )
    shifts = info.selectExpr("conv_id", "h - size(taken) AS shift").where("shift > 0")
    kept = own.join(shifts, "conv_id", "left").selectExpr(
        "conv_id",
        "if(pos > h, pos - coalesce(shift, 0), 0) AS d",
        "if(pos > h, tid, NULL) AS tid",
        "if(pos > h, words, 0) AS words",
        "cum",
    )
    return kept.union(inherited)


# ---- distinct sequences


def _slice(begin: int, end: int) -> Column:
    inside = F.when(F.col("d").between(begin + 1, end), F.struct("d", "tid", "words"))
    return F.transform(
        F.sort_array(F.collect_list(inside)),
        lambda t: F.struct(t["tid"].alias("tid"), t["words"].alias("words")),
    )


def _end_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (h1, h2, len, conv_id): up to ``IDS`` ids of one sequence
    as one row."""
    key, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))

    def batch_of() -> pa.RecordBatch:
        names = ["h1", "h2", "len", "first", "n", "ids"]
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    for batch in batches:
        for *k, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key or len(ids) == IDS:
                close()
                key, ids = k, []
            ids.append(conv)
        if out:
            yield batch_of()
            out = []
    close()
    if out:
        yield batch_of()


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each sequence's pieces, which arrive in their order."""
    key, digest, many = None, None, 0
    for batch in batches:
        out = []
        for h1, h2, n, _, ids_n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (h1, h2, n) != key:
                if many > 1:
                    out.append((*key, digest.hexdigest()))
                key, digest, many = (h1, h2, n), hashlib.sha256(), 0
            digest.update(("," if many else "").encode() + ids.encode())
            many += ids_n
        if out:
            yield _ends(out)
    if many > 1:
        yield _ends([(*key, digest.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(["h1", "h2", "len", "ends"], map(list, zip(*rows)))))


def sequences(steps: DataFrame, window: int) -> DataFrame:
    """Distinct sequences: the smallest ``conv``, how many conversations have it
    (``weight``), ``len``, the ``items`` (turn ids and words) of the first window,
    the words after it (``rest``), all words (``total``), and the digest of the
    conversations (``ends``)."""
    turn = F.col("d") > 0
    seqs = stage(
        steps.groupBy("conv_id").agg(
            F.coalesce(F.bit_xor(F.when(turn, F.xxhash64("d", "tid"))), F.lit(0)).alias("h1"),
            F.coalesce(F.bit_xor(F.when(turn, F.xxhash64("tid", "d", F.lit(1)))), F.lit(0)).alias("h2"),
            F.max("d").alias("len"),
            F.sum(F.when(F.col("d") > window, F.col("words")).otherwise(0)).alias("rest"),
            F.max(F.coalesce("cum", F.lit(0))).alias("total"),
            _slice(0, window).alias("items"),
        ),
        "sequences",
    )
    key = ["h1", "h2", "len"]
    groups = seqs.groupBy(*key).agg(
        F.min("conv_id").alias("conv"),
        F.count("*").alias("weight"),
        F.first("rest").alias("rest"),
        F.min_by("total", "conv_id").alias("total"),
        F.first("items").alias("items"),
    )
    ends = (
        seqs.select(*key, "conv_id")
        .repartitionByRange(*key, "conv_id")
        .sortWithinPartitions(*key, "conv_id")
        .mapInArrow(_end_pieces, "h1 long, h2 long, len long, first long, n long, ids string")
        .repartition(*key)
        .sortWithinPartitions(*key, "first")
        .mapInArrow(_end_digests, "h1 long, h2 long, len long, ends string")
    )
    alone = F.sha2(F.col("conv").cast("string"), 256)
    return groups.join(ends, key, "left").select(
        "conv", "weight", "len", "rest", "total", "items", F.coalesce("ends", alone).alias("ends")
    )


# ---- containers


def _burst(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Rows with their container's ``head``, the turns it stands for (``at``) and
    the ``path`` of burst heads above it; and the number of burst levels.  Rows
    that end at a burst head have no container."""
    rows = rows.selectExpr(
        "*", "top AS head", "0 AS at", "true AS moving",
        "cast(array() AS array<struct<head: binary, words: int>>) AS path",
    )
    levels = 0
    while True:
        sizes = rows.where("moving").groupBy("head").count()
        # at most rows / limit of them, which MOST_HEADS bounds
        large = stage(sizes.where(F.col("count") > limit).select("head"), "burst-heads")
        if large.isEmpty():
            return rows, levels
        others = [c for c in rows.columns if c not in ("head", "at", "moving", "path")]
        marked = rows.join(F.broadcast(large.withColumn("large", F.lit(True))), "head", "left")
        rows = marked.selectExpr(
            *others,
            "moving AND coalesce(large, false) AS bursts", "head", "at", "path",
        ).selectExpr(
            *others,
            """CASE WHEN bursts AND size(items) > at THEN unhex(md5(concat(head, items[at].tid)))
                    WHEN NOT bursts THEN head END AS head""",
            "if(bursts AND size(items) > at, at + 1, at) AS at",
            "bursts AND size(items) > at AS moving",
            """if(bursts, array_append(path, named_struct('head', head, 'words',
                    if(at > 0, get(items, at - 1).words, 0))), path) AS path""",
        )
        levels += 1
        if levels % 4 == 0:
            rows = stage(rows, "burst")


class _Node:
    """A node on the sweep's stack; ``waiting`` children learn its smallest id."""

    __slots__ = ("children", "conv", "ends", "leaves", "n", "saved", "tid", "waiting", "words")

    def __init__(self, tid: bytes, words: int):
        self.tid, self.words = tid, words
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ends, self.waiting = None, None, []

    def take(self, conv: int, n: int, children: int, leaves: int, saved: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved


class _Sweep:
    """Nodes of containers whose sequences arrive sorted."""

    def __init__(self, base: int):
        self.base, self.out, self.stack, self.head = base, [], [], None

    def _pop(self) -> _Node:
        node = self.stack.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        for depth, conv, n, children, leaves, saved, ends in node.waiting:
            self.out.append((False, None, None, conv, depth, node.conv, n, children, leaves, saved, ends, None))
        if self.stack:
            above = self.stack[-1]
            above.take(node.conv, node.n, 1, node.leaves, node.saved)
            depth = self.base + self.at + len(self.stack)
            above.waiting.append(
                (depth, node.conv, node.n, node.children, node.leaves, node.saved, node.ends)
            )
        return node

    def close(self) -> None:
        if self.head is None:
            return
        while len(self.stack) > 1:
            self._pop()
        top = self._pop()
        self.out.append((
            True, self.head, self.at, top.conv, self.base + self.at, None, top.n,
            top.children, top.leaves, top.saved, top.ends, self.path,
        ))

    def add(self, head, at, path, tids, words, conv, weight, children, leaves, saved, ends) -> None:
        if head != self.head:
            self.close()
            self.head, self.at, self.path = head, at, path
            # the own words of a window's top are its window's, or none at the root
            self.stack = [_Node(head, words[at - 1] if at else 0)]
        same, upto = 0, min(len(self.stack) - 1, len(tids) - at)
        while same < upto and self.stack[same + 1].tid == tids[at + same]:
            same += 1
        while len(self.stack) - 1 > same:
            self._pop()
        for i in range(at + same, len(tids)):
            self.stack.append(_Node(tids[i], words[i]))
        self.stack[-1].take(conv, weight, children, leaves, saved)
        self.stack[-1].ends = self.stack[-1].ends or ends


def _swept(rows: DataFrame, base: int) -> DataFrame:
    """Nodes below the containers' heads, and one row for each head (``top``)."""

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(map(list, zip(*out)), _SWEPT)]
        return pa.RecordBatch.from_arrays(columns, schema=_SWEPT)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep(base)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                state.add(*row)
            if state.out:
                yield table(state.out)
                state.out = []
        state.close()
        if state.out:
            yield table(state.out)

    swept = rows.selectExpr(
        "head", "at", "path", "transform(items, t -> t.tid) AS tids", "transform(items, t -> t.words) AS words",
        "conv", "weight", "children", "leaves", "saved", "ends",
    )
    schema = f"top boolean, head binary, at int, {NODE}, path array<struct<head: binary, words: int>>"
    return swept.repartition("head").sortWithinPartitions("head", "tids").mapInArrow(sweep, schema)


def _heads(tops: DataFrame, ended: DataFrame) -> DataFrame:
    """Burst heads: ``head, level, above`` (the head it hangs under) and a node's
    numbers, summed up from the containers and sequences below."""
    reports = tops.selectExpr(
        "path", "conv_id", "n_convs", "1 AS children", "n_leaves", "saved_tokens", "cast(NULL AS string) AS ends"
    ).union(ended.selectExpr("path", "conv", "weight", "children", "leaves", "saved", "ends"))
    summed = (
        reports.select("*", F.posexplode("path").alias("level", "p"))
        .withColumn("own", F.expr("level = size(path) - 1"))
        .groupBy(F.col("p.head").alias("head"))
        .agg(
            F.first("level").alias("level"),
            F.first("p.words").alias("words"),
            F.first(F.expr("slice(transform(path, x -> x.head), 1, level + 1)")).alias("line"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum(F.expr("if(own, children, 0)")).alias("children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
            F.max(F.expr("if(own, ends, NULL)")).alias("ends_sha256"),
        )
    )
    summed = stage(summed, "head-sums")
    # what heads save themselves, and that they are children, counts for those above
    more = (
        summed.where("level > 0")
        .select("line", F.expr("(n_convs - 1) * words").alias("more"), F.posexplode("line").alias("at", "head"))
        .groupBy("head")
        .agg(F.sum("more").alias("more"), F.sum(F.expr("if(at = size(line) - 2, 1, 0)")).alias("heads"))
    )
    return summed.join(more, "head", "left").selectExpr(
        "head", "level", "get(line, level - 1) AS above", "conv_id", "n_convs",
        "children + coalesce(heads, 0) AS n_children", "n_leaves",
        "saved_tokens + coalesce(more, 0) AS saved_tokens", "ends_sha256",
    )


def _window(
    rows: DataFrame, steps: DataFrame, number: int, window: int, container: int
) -> tuple[list[DataFrame], DataFrame]:
    """Nodes below the tops of this window's containers, and a row for each top.

    ``rows`` have ``top`` and the columns of :func:`sequences`, of this window.
    """
    begin, end = number * window, (number + 1) * window
    nodes = []
    below = ["0L AS children", "0L AS leaves", "0L AS saved"]
    wanted = ["top", "items", "conv", "weight", "children", "leaves", "saved", "ends"]
    here = rows.where(f"len < {end}").selectExpr("*", *below).select(wanted)
    full = rows.where(f"len >= {end}").withColumn(
        "next", F.expr("unhex(md5(concat(hex(top), array_join(transform(items, t -> hex(t.tid)), ''))))")
    )
    if not full.isEmpty():
        full = stage(full, "full-windows")
        shared = full.groupBy("next").count().where("count > 1").select("next")
        alone = stage(full.join(shared, "next", "left_anti"), "chains")
        together = full.join(shared, "next", "left_semi")
        here = here.union(
            alone.selectExpr(
                "top", "items", "conv", "weight", f"if(len > {end}, 1L, 0L) AS children",
                f"if(len > {end}, 1L, 0L) AS leaves", "(weight - 1) * rest AS saved",
                f"if(len > {end}, NULL, ends) AS ends",
            )
        )
        chain = alone.select("conv", "weight", "len", "total", "ends").withColumnRenamed("conv", "conv_id")
        nodes.append(
            steps.where(f"d > {end}").join(chain, "conv_id").selectExpr(
                "conv_id", "d AS depth", "conv_id AS parent_conv_id", "weight AS n_convs",
                "if(d < len, 1L, 0L) AS n_children", "1L AS n_leaves",
                "(weight - 1) * (total - cum + words) AS saved_tokens",
                "if(d = len, ends, NULL) AS ends_sha256",
            )
        )
        if not together.isEmpty():
            following = (
                steps.where(f"d > {end} AND d <= {end + window}")
                .groupBy(F.col("conv_id").alias("conv"))
                .agg(_slice(end, end + window).alias("items"))
            )
            words = "aggregate(items, 0L, (sum, t) -> sum + t.words)"
            deeper = (
                together.drop("items", "top").withColumnRenamed("next", "top")
                .join(following, "conv", "left")
                .withColumn("items", F.expr("coalesce(items, array())"))
                .withColumn("rest", F.expr(f"rest - {words}"))
            )
            deep, tops = _window(stage(deeper, "window"), steps, number + 1, window, container)
            nodes += deep
            merged = together.groupBy("next").agg(F.first("top").alias("top"), F.first("items").alias("items"))
            here = here.union(
                merged.join(tops.withColumnRenamed("top", "next"), "next").selectExpr(
                    "top", "items", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
                )
            )
        here = stage(here, "window-rows")

    limit = max(container, here.count() // MOST_HEADS)
    dealt, levels = _burst(here, limit)
    swept = stage(_swept(dealt.where("head IS NOT NULL"), begin), "swept")
    nodes.append(swept.where("NOT top").select(_COLUMNS))
    reports = swept.where("top AND at > 0")
    whole = swept.where("top AND at = 0").withColumn("top", F.col("head"))
    columns = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = whole.select("top", *columns)
    if levels:
        heads = stage(_heads(reports, dealt.where("head IS NULL")), "heads")
        ids = heads.select(F.col("head").alias("above"), F.col("conv_id").alias("parent_conv_id"))
        hung = reports.drop("parent_conv_id").withColumn("above", F.expr("element_at(path, -1).head"))
        inner = heads.where("level > 0").withColumn("depth", F.col("level") + F.lit(begin).cast("long"))
        nodes += [part.join(ids, "above").select(_COLUMNS) for part in (hung, inner)]
        tops = tops.union(heads.where("level = 0").select("head", *columns))
    return nodes, tops


def trie(steps: DataFrame, window: int = WINDOW, container: int = CONTAINER) -> DataFrame:
    """The nodes of all sequences in ``steps`` (``conv_id, d, tid, words, cum``;
    ``d`` 0 names a conversation, ``cum`` sums words up to the step, from any start)."""
    root = F.unhex(F.md5(F.lit("root")))
    rows = stage(sequences(steps, window).withColumn("top", root), "window")
    nodes, tops = _window(rows, steps, 0, window, container)
    found = tops.selectExpr(
        "conv_id", "0L AS depth", "cast(NULL AS long) AS parent_conv_id", "n_convs",
        "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
    for part in nodes:
        found = found.union(part)
    return found.fillna(_EMPTY, ["ends_sha256"])


def conversation_trie(turns: DataFrame, window: int = WINDOW, container: int = CONTAINER) -> DataFrame:
    """The nodes of the rebuilt conversations of ``turns`` (``conv_id, turn, role, text``)."""
    if window <= MOST_INHERITED:
        raise ValueError("a window holds more turns than conversations take over")
    return trie(rebuilt(turns), window, container)
