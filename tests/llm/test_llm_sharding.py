"""Sharding next to plain sums and a plain greedy packing."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cloakspan.llm import sharding

DOCS = "doc_id long, text string, size int, shard int, row_no int"


def plain_place(vectors, residual):
    left, out = residual.copy(), {}
    for i in sorted(range(len(vectors)), key=lambda i: (-max(vectors[i]), i)):
        scores = [sum(w * a * b for w, a, b in zip(sharding.WEIGHTS, vectors[i], r)) for r in left]
        best = max(range(len(left)), key=lambda s: (round(scores[s], 12), -s))
        left[best] -= vectors[i]
        out[i] = best
    return [out[i] for i in range(len(vectors))]


def checked(docs, rows, shards=sharding.SHARDS):
    """The contract's columns of each row, and gapless slots."""
    assert len(rows) == len(docs)
    plain = lambda t: (t or "").encode()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(
        ((i, len(plain(t)) + 1, zlib.crc32(plain(t))) for i, t in docs), key=str
    )
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))


def spread(rows, of, shards=sharding.SHARDS):
    sums = np.zeros(shards)
    for r in rows:
        sums[r["shard"]] += of(r)
    return (sums.max() - sums.min()) / sums.mean()


def test_place_equals_a_plain_loop():
    dealt = np.random.default_rng(5)
    for many in (0, 1, 40, 400):
        vectors = dealt.random((many, 3)) / max(1, many)
        residual = np.full((16, 3), 1 / 16)
        assert list(sharding.place(vectors, residual.copy())) == plain_place(vectors, residual)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = sharding.shard(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    checked(list(texts.items()), rows)
    for r in rows:
        assert r["tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
    assert spread(rows, lambda r: r["size"]) < 0.02
    assert spread(rows, lambda r: 1) < 0.1 and spread(rows, lambda r: r["tokens"]) < 0.1


@pytest.mark.parametrize("pack", [1024, 50])
def test_hot_group_and_long_document(spark, pack):
    """Copies of one text fill a third of all rows; light groups stay whole."""
    docs = [(i, "the same text again") for i in range(1500)] + [(i, None) for i in range(40)]
    docs += [(i, f"text number {i // 2} " + "x" * (i % 97)) for i in range(3000)]
    docs += [(9000 + i, "long " * 700 + str(i)) for i in range(20)]
    df = spark.createDataFrame([(*d, 1, 1, 1) for d in docs], DOCS).repartition(5)
    rows = sharding.shard(df, pack=pack).collect()
    checked(docs, rows)
    assert spread(rows, lambda r: r["size"]) < 0.02
    whole = defaultdict(set)
    for r in rows:
        whole[r["text_crc32"]].add(r["shard"])
    split = [c for c, held in whole.items() if len(held) > 1]
    assert set(split) <= {zlib.crc32(b"the same text again"), 0}
    assert len(whole[zlib.crc32(b"the same text again")]) == 16


def test_a_document_larger_than_a_shard(spark):
    docs = [(None, "y" * 50_000), *((i % 7, f"short {i}") for i in range(2000))]
    df = spark.createDataFrame([(*d, 1, 1, 1) for d in docs], DOCS)
    rows = sharding.shard(df).collect()
    checked(docs, rows)
    full = next(r["shard"] for r in rows if r["size"] > 50_000)
    others = [r for r in rows if r["shard"] != full]
    sums = defaultdict(int)
    for r in others:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.05 * max(sums.values())


def test_empty_and_tiny_tables(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(1, ""), (2, None), (None, "a b"), (2, None)]
    rows = sharding.shard(spark.createDataFrame([(*d, 1, 1, 1) for d in docs], DOCS)).collect()
    checked(docs, rows)
