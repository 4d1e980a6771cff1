"""Byte-level BPE through a sentencepiece model written from the vocabulary.

A rank file holds byte strings and their ranks.  ``model_bytes`` maps every
byte to one printable character, writes each entry as a BPE piece whose score
is its negative rank, and asks for no normalisation at all, so sentencepiece
merges in exactly the order of the ranks.  Texts are cut into pre-tokens first
and each pre-token is encoded by itself; decoding maps ids to pieces and the
pieces' characters back to bytes.

Defined cases: a null text counts as empty; an empty text has no ids; repeated
rows, null ids and further columns of any name pass through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Pre-tokens remembered by a Python worker; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Rows whose ids a worker holds at a time.
ROWS = 256


def byte_characters() -> list[str]:
    """One printable character for every byte: Latin-1's visible characters
    stand for themselves, the others follow from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, at their ranks."""
    pieces: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                pieces[int(rank)] = base64.b64decode(token)
    if sorted(pieces) != list(range(len(pieces))):
        raise ValueError("ranks must be consecutive from 0")
    return [pieces[rank] for rank in range(len(pieces))]


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; ids equal ranks, and the unknown
    piece, which no mapped byte can reach, has the id after the last."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    table = byte_characters()
    model = proto.ModelProto()
    for rank, piece in enumerate(pieces):
        model.pieces.add(piece="".join(table[b] for b in piece), score=-float(rank))
    model.pieces.add(
        piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN
    )
    trainer = model.trainer_spec
    trainer.model_type = proto.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = (
        len(pieces), -1, -1, -1,
    )
    rules = model.normalizer_spec
    rules.name = "identity"
    rules.add_dummy_prefix = False
    rules.remove_extra_whitespaces = False
    rules.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """Encodes and decodes with the ranks of one file and one split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.whole = {piece: rank for rank, piece in enumerate(self.pieces)}
        self.model = sentencepiece.SentencePieceProcessor(
            model_proto=model_bytes(self.pieces)
        )
        # The rank files' own library knows no control character as white space
        # beyond Unicode's property; spell that out for this regex library.
        self.find = regex.compile(
            pattern.replace(r"[^\s", r"[^\p{White_Space}")
            .replace(r"\s", r"\p{White_Space}")
            .replace(r"\S", r"\P{White_Space}")
        ).findall
        table = byte_characters()
        self.to_characters = {b: table[b] for b in range(256)}
        self.known: dict[str, tuple[int, ...]] = {}
        #: id to bytes, by the inverse of the byte map
        inverse = {character: byte for byte, character in enumerate(table)}
        self.inverse = [
            bytes(inverse[c] for c in self.model.id_to_piece(i))
            for i in range(len(self.pieces))
        ]

    def _learn(self, words: list[str]) -> None:
        """Encode pre-tokens that have not been met."""
        unmapped = []
        for word in words:
            rank = self.whole.get(word.encode("utf-8", "surrogatepass"))
            if rank is None:
                unmapped.append(word)
            else:
                self.known[word] = (rank,)
        mapped = [
            word.encode("utf-8", "surrogatepass")
            .decode("latin-1")
            .translate(self.to_characters)
            for word in unmapped
        ]
        for word, ids in zip(unmapped, self.model.encode(mapped, num_threads=1)):
            self.known[word] = tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        words = self.find(text) if text else []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        missing = set(words).difference(self.known)
        if missing:
            self._learn(list(missing))
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.inverse.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids array<int>`` in place of its text (a column ``ids`` is
    replaced).  Every text is decoded again and must come back unchanged.  One
    narrow pass; a worker holds the ids of some rows at a time."""
    kept = [f for f in df.schema.fields if f.name not in (text, "ids")]
    source = df.select(*[f"`{f.name}`" for f in kept], f"`{text}`")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for rows in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                found = []
                for value in _strings(rows.column(len(kept))):
                    ids = bpe.encode(value)
                    if bpe.decode(ids) != (value or "").encode():
                        raise ValueError("a text does not survive its encoding")
                    found.append(np.array(ids, dtype=np.int32))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[: len(kept)], pa.ListArray.from_arrays(ends, pa.array(flat))],
                    [*[f.name for f in kept], "ids"],
                )

    return source.mapInArrow(encode, StructType([*kept, StructField("ids", ArrayType(IntegerType()))]))


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes that its ids stand for; null for null
    (a column ``decoded`` is replaced)."""
    kept = [f for f in df.schema.fields if f.name != "decoded"]
    at = [f.name for f in kept].index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            found = [
                None if value is None else bpe.decode(value)
                for value in _strings(batch.column(at))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())],
                [*[f.name for f in kept], "decoded"],
            )

    return df.select(*[f"`{f.name}`" for f in kept]).mapInArrow(
        decode, StructType([*kept, StructField("decoded", BinaryType())])
    )


def digest_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, ``n_tokens``, and the SHA-256 of the decimal ids
    (comma-joined) and of the decoded bytes, made where the ids are."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        decimal = list(map(str, range(len(bpe.pieces)))).__getitem__
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in _strings(batch.column(1)):
                ids = bpe.encode(text)
                counts.append(len(ids))
                joined = ",".join(map(decimal, ids)).encode()
                of_ids.append(hashlib.sha256(joined).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(of_ids, pa.string()),
                    pa.array(of_bytes, pa.string()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(f"`{key}`", "text").mapInArrow(
        digest,
        f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def _strings(column: pa.Array) -> Iterator:
    """One value at a time, so a batch is never held twice."""
    return map(lambda i, c: c[i].as_py(), range(len(column)), repeat(column))
