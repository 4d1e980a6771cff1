"""Exact token counts of texts of any length, by overlap resynchronisation.

A huge text is encoded in overlapping chunks.  Two neighbours are spliced at a
boundary that both encodings have, at the same offset of the text, and that is
proven stable: the vocabulary holds no piece in which a word-start mark follows
another character, so no merge ever crosses the start of a run of spaces, and
what stands on either side is encoded independently of the other.  Where the
overlap holds no such boundary it is widened, at last to the whole chunk, which
is then encoded together with its successor.

The proof needs a model that leaves texts as they are (identity normalisation,
white space kept) and spells unknown characters in bytes; with any other model
texts are encoded whole.

Defined cases: a null or empty text has no tokens and no bytes; repeated rows,
null ids and further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of the first overlap tried.
CHUNK, OVERLAP = 16_384, 256

MARK = "▁"


class ChunkedEncoder:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than the chunk")
        self.chunk, self.overlap = chunk, overlap
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        parsed = proto.ModelProto()
        parsed.ParseFromString(self.model.serialized_model_proto())
        rules = parsed.normalizer_spec
        self.prefix = int(rules.add_dummy_prefix)
        self.splices = (
            parsed.trainer_spec.model_type == proto.TrainerSpec.BPE
            and parsed.trainer_spec.byte_fallback
            and not rules.precompiled_charsmap
            and not rules.remove_extra_whitespaces
            and rules.escape_whitespaces
            and not parsed.trainer_spec.treat_whitespace_as_suffix
            and not any(MARK in p.piece.lstrip(MARK) for p in parsed.pieces)
        )
        #: characters of the text that a piece stands for; a character in
        #: bytes counts at its first one
        self.lengths = np.array(
            [
                int(int(p.piece[3:5], 16) & 0xC0 != 0x80)
                if p.type == proto.ModelProto.SentencePiece.BYTE
                else len(p.piece)
                for p in parsed.pieces
            ],
            dtype=np.int64,
        )

    def _piece(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk, and where in the text each one begins."""
        ids = np.array(self.model.encode(text[begin:end]), dtype=np.int32)
        ends = np.cumsum(self.lengths[ids]) - self.prefix
        if len(ids) and ends[-1] != end - begin:
            raise ValueError("pieces do not add up to the text")
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64) + begin
        return ids, begins[: len(ids)]

    @staticmethod
    def _stable(text: str, at: int) -> bool:
        return text[at] == " " and text[at - 1] not in (" ", MARK)

    def _common(self, text: str, left: np.ndarray, right: np.ndarray, begin: int) -> int:
        """The last boundary both have after ``begin`` that is stable, or -1."""
        for at in np.intersect1d(left, right)[::-1]:
            if at <= begin:
                break
            if self._stable(text, int(at)):
                return int(at)
        return -1

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.chunk or not self.splices:
            return self.model.encode(text)
        parts: list[np.ndarray] = []
        # the current chunk was encoded from origin; its tokens count from begin
        origin, begin, end, size = 0, 0, self.chunk, len(text)
        ids, begins = self._piece(text, origin, end)
        while end < size:
            overlap, at = self.overlap, -1
            while at < 0 and end - overlap > begin:
                start = end - overlap
                stop = min(start + max(self.chunk, 2 * overlap), size)
                next_ids, next_begins = self._piece(text, start, stop)
                at = self._common(text, begins, next_begins, start)
                overlap *= 2
            if at < 0:  # nothing to align on: take more text at once
                end = min(origin + 2 * (end - origin), size)
                ids, begins = self._piece(text, origin, end)
                ids, begins = ids[begins >= begin], begins[begins >= begin]
                continue
            parts.append(ids[begins < at])
            keep = next_begins >= at
            ids, begins = next_ids[keep], next_begins[keep]
            origin, begin, end = start, at, stop
        parts.append(ids)
        return np.concatenate(parts).tolist()

    def counts(self, texts: list[str | None]) -> list[int]:
        """Token counts; short texts go to the library together."""
        found = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if t and len(t) <= self.chunk]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1)):
            found[i] = len(ids)
        for i, text in enumerate(texts):
            if text and len(text) > self.chunk:
                found[i] = len(self.encode(text))
        return found


@lru_cache(maxsize=2)
def chunked_encoder(path: str, chunk: int, overlap: int) -> ChunkedEncoder:
    return ChunkedEncoder(path, chunk, overlap)


def count_tokens(
    df: DataFrame,
    path: str,
    key: str = "doc_id",
    limit: int = 4096,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per row: ``key``, ``n_bytes``, ``n_tokens`` and whether it has more
    tokens than ``limit``.  One narrow pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunked_encoder(path, chunk, overlap)
        for batch in batches:
            for rows in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                counts = encoder.counts(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(counts, pa.int64())],
                    [key, "n_bytes", "n_tokens"],
                )

    kind = df.schema[key].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return (
        df.select(f"`{key}`", "text", n_bytes.alias("n_bytes"))
        .mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
