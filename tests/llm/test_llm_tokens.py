"""Byte-level BPE and token counts next to the libraries themselves."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from cloakspan.llm import byte_bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN

TEXTS = [
    None, "", " ", "\n\n  \n", "don't stop, we'll go on", "It's 12345 °C  in Köln!",
    "日本語のテキスト 한국어 عربى", "😀😃 <|endoftext|> <s>", "\x00\x1c\x85 end", "a" * 5_000,
    "word " * 20_000, "x\ty\r\nz" * 50,
]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(many, seed=3):
    rng = random.Random(seed)
    ranges = [(32, 127), (0, 64), (0xA0, 0x250), (0x400, 0x460), (0x4E00, 0x4F00), (0x1F600, 0x1F640)]
    for _ in range(many):
        yield "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(50)))


def test_byte_bpe_equals_the_rank_library(reference):
    bpe = byte_bpe.ByteBpe(RANKS, PATTERN)
    for text in [*TEXTS, *random_texts(1_500)]:
        ids = bpe.encode(text)
        assert ids == reference.encode_ordinary(text or "")
        assert bpe.decode(ids) == (text or "").encode()


def test_byte_bpe_forgets_when_its_memory_is_full(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    bpe = byte_bpe.ByteBpe(RANKS, PATTERN)
    for text in random_texts(100):
        assert bpe.encode(text) == reference.encode_ordinary(text)


def test_byte_bpe_tables(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "again", "x"), (4, TEXTS[4], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = byte_bpe.encode_texts(df, RANKS, PATTERN)
    assert made.columns == ["doc_id", "ids"]
    back = byte_bpe.decode_ids(made, RANKS, PATTERN).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in back) == sorted(
        (i or -1, (t or "").encode()) for i, t, _ in rows
    )
    digests = {(r["doc_id"], r["n_tokens"]): r for r in byte_bpe.digest_texts(df, RANKS, PATTERN).collect()}
    for i, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        row = digests[(i, len(ids))]
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.encode_texts(df.limit(0), RANKS, PATTERN).count() == 0


def test_chunks_are_spliced_without_a_trace():
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    small = token_counts.ChunkedEncoder(PIECES, chunk=40, overlap=7)
    assert small.splices
    rng = random.Random(1)
    parts = ["the ", "a", "  ", " hello", "▁", "é", "日本", "😀", "\n", "ing", "\x00", "<s>"]
    for _ in range(800):
        text = "".join(
            rng.choice([*parts, "x" * rng.randrange(90)]) for _ in range(rng.randrange(80))
        )
        assert small.encode(text) == whole.encode(text)
    usual = token_counts.ChunkedEncoder(PIECES)
    for text in ("word and more " * 9_000, "y" * 60_000, "y" * 40_000 + " z" * 9_000):
        assert usual.encode(text) == whole.encode(text)
    with pytest.raises(ValueError):
        token_counts.ChunkedEncoder(PIECES, chunk=10, overlap=10)


def test_token_counts_table(spark):
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "again", 1), (4, TEXTS[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(df, PIECES, limit=100).collect()
    want = []
    for i, text, _ in rows:
        n = len(whole.encode(text or ""))
        want.append((i, len((text or "").encode()), n, n > 100))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.count_tokens(df.limit(0), PIECES).count() == 0
