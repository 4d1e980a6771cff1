"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A document's fingerprint has 64 bits from the XXH64 hashes (seed 42) of its
3-word shingles.  Two documents are linked if their fingerprints differ in at
most 3 bits; groups are the connected components of the links.

How links are found: a fingerprint is cut into three segments of 22, 21 and 21
bits, each a (zero-filled) word of the Golay code.  Three errors over three
segments leave two segments with at most one error each, and a word one bit
away from x has x's nearest codeword among its own nearby ones.  So each
fingerprint is filed under the nearest codewords of each pair of segments, and
looked up under all nearby ones: every link meets in some key.  What meets is
verified on all 64 bits.

Scale: equal fingerprints are one class before anything else, so copies cost
one row each.  Keys with many rows are split into a grid of cells whose sizes
are bounded (their list is planned from a sample; any plan gives the same
links).  A task emits a spanning forest of the links in what it holds, never
all pairs.

Defined cases: a null text counts as empty; texts without words have the
fingerprint zero and are linked like any other; repeated rows are documents of
their own.  A null id takes part; its component is the smallest id there is in
its group, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspan.functions.staging import stage

from .components import components
from .golay import decode

SEED = 42
SHINGLE = 3
RADIUS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))

#: Fingerprints looked at to plan the split of hot keys, the rows a key must
#: have among them, and the rows wanted in a side of a cell.  The driver gets
#: at most PLAN_SAMPLE * 108 / PLAN_LEAST keys.
PLAN_SAMPLE, PLAN_LEAST, CELL_ROWS = 20_000, 32, 2_048

#: Pairs compared in one numpy step.
STEP_PAIRS = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# --- fingerprints ---------------------------------------------------------


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    import xxhash

    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8"
    )
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 14):
        octets = hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(texts[i].as_py()) for i in range(len(texts))]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed)], [key, "fp"]
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(f"`{key}`", F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(
        compute, f"`{key}` {kind}, fp bigint"
    )


# --- keys -----------------------------------------------------------------


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (position of the fingerprint, key, filed there).

    A key names a pair of segments and a codeword of each.
    """
    unsigned = fps.view(np.uint64)
    decoded = [
        decode((unsigned >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        for shift, width in SEGMENTS
    ]
    rows, keys, filed = [], [], []
    for number, (a, b) in enumerate(PAIRS):
        near_a, near_b = decoded[a][1], decoded[b][1]
        valid = (near_a >= 0)[:, :, None] & (near_b >= 0)[:, None, :]
        key = near_a.astype(np.int64)[:, :, None] << 12 | near_b[:, None, :]
        row, i, j = np.nonzero(valid)
        rows.append(row)
        keys.append(key[row, i, j] | number << 24)
        filed.append((i == 0) & (j == 0))  # the nearest come first
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(filed)


def _spread(fps: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """A chunk for each fingerprint, from all its bits."""
    mixed = fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % chunks.astype(np.uint64)).astype(np.int64)


def _cells(
    fps: np.ndarray, hot: np.ndarray, hot_chunks: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(code, fingerprint) rows; a code is a key, a cell of its grid, and a
    last bit that says whether the row is filed there or looks up only."""
    row, key, filed = keys_of(fps)
    where = np.searchsorted(hot, key)
    where[where == len(hot)] = 0
    is_hot = (hot[where] == key) if len(hot) else np.zeros(len(key), dtype=bool)
    codes = [key[~is_hot] << 37 | filed[~is_hot]]
    found = [fps[row[~is_hot]]]
    if is_hot.any():
        row, key, filed = row[is_hot], key[is_hot], filed[is_hot]
        chunks = hot_chunks[where[is_hot]]
        own = _spread(fps[row], chunks)
        for as_filed in (True, False):  # a filed row also looks up
            use = filed if as_filed else np.ones(len(row), dtype=bool)
            times = chunks[use]
            other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            mine = np.repeat(own[use], times)
            i, j = (mine, other) if as_filed else (other, mine)
            codes.append(np.repeat(key[use], times) << 37 | i << 19 | j << 1 | int(as_filed))
            found.append(np.repeat(fps[row[use]], times))
    return np.concatenate(codes), np.concatenate(found)


def _hot_keys(classes: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that need a grid, and the chunks of each side."""
    taken = min(total, PLAN_SAMPLE)
    sample = classes.where(F.expr(f"pmod(xxhash64(fp), {total}) < {taken}")).select("fp")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                _, found, _ = keys_of(batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["key"])

    share = total / taken
    least = max(PLAN_LEAST, int(CELL_ROWS / share))
    rows = (
        sample.mapInArrow(keys, "key bigint").groupBy("key").count()
        .where(F.col("count") > least).collect()
    )
    rows.sort()
    chunks = [min(int(r["count"] * share / CELL_ROWS) + 1, 1 << 18) for r in rows]
    return (
        np.array([r["key"] for r in rows], dtype=np.int64),
        np.array(chunks, dtype=np.int64),
    )


# --- links ----------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given ones connect: (value, smallest)."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS


def _link_large(fps: np.ndarray, filed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large group.  A filed row is compared with the rows of
    other components only, so a dense group costs little more than its size."""
    label = np.arange(len(fps))
    open_rows = filed.copy()
    while open_rows.any():
        sizes = np.bincount(label, minlength=len(fps))
        candidates = np.flatnonzero(open_rows)
        own = label[candidates[np.argmax(sizes[label[candidates]])]]
        rows = candidates[label[candidates] == own]
        others = np.flatnonzero(label != own)
        rows = rows[: max(1, STEP_PAIRS // max(1, len(others)))]
        open_rows[rows] = False
        if len(others):
            hit = _near(fps[rows][:, None], fps[others][None, :]).any(axis=0)
            joined = np.unique(label[others[hit]])
            if len(joined):
                label[np.isin(label, joined)] = own
    first = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(first, label, fps)
    root = first[label]
    moved = root != fps
    return fps[moved], root[moved]


def _link_groups(codes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups, given in the order of their codes."""
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] >> 1 != codes[:-1] >> 1)))
    sizes = np.diff(np.append(starts, len(codes)))
    filed = (codes & 1).astype(bool)
    found_a, found_b = [], []
    for g in np.flatnonzero(sizes > 256):
        part = slice(starts[g], starts[g] + sizes[g])
        a, b = _link_large(fps[part], filed[part])
        found_a.append(a)
        found_b.append(b)
    group = np.repeat(np.arange(len(starts)), sizes)
    small = (sizes > 1) & (sizes <= 256)
    left = np.flatnonzero(filed & small[group])
    times = sizes[group[left]]
    upto = np.cumsum(times)
    at = 0
    while at < len(left):
        done = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + STEP_PAIRS)))
        n = times[at:stop]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = np.repeat(fps[left[at:stop]], n)
        y = fps[np.repeat(starts[group[left[at:stop]]], n) + within]
        near = _near(x, y) & (x != y)
        found_a.append(x[near])
        found_b.append(y[near])
        at = stop
    if not found_a:
        return codes[:0], codes[:0]
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows that arrive sorted by code.  The last group of what
    has arrived waits for the next batch."""
    codes, fps = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(upto: int) -> pa.RecordBatch:
        a, b = _link_groups(codes[:upto], fps[:upto])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        codes = np.concatenate((codes, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(codes) < 200_000:
            continue
        upto = int(np.searchsorted(codes >> 1, codes[-1] >> 1))
        if upto:
            yield out(upto)
            codes, fps = codes[upto:], fps[upto:]
    if len(codes):
        yield out(len(codes))


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` of which one
    can be reached from the other in steps of at most 3 bits."""
    total = classes.count()
    hot, hot_chunks = _hot_keys(classes, max(total, 1))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                fps = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False)
                codes, found = _cells(fps, hot, hot_chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes), pa.array(found)], ["code", "fp"]
                )

    return (
        classes.select("fp")
        .mapInArrow(cells, "code bigint, fp bigint")
        .repartition(F.expr("shiftright(code, 1)"))
        .sortWithinPartitions("code")
        .mapInArrow(_links, "a bigint, b bigint")
    )


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest key of the row's group."""
    marked = stage(fingerprints(df, key, text), "fingerprints")
    classes = stage(
        marked.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-classes"
    )
    reached = components(links(classes))
    of_class = classes.join(reached, classes.fp == reached.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_class.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
