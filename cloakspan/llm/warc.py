"""WARC archives and a two-level capture index over them.

``write_archives`` writes one record per row into ``.warc.gz`` files, each
record its own gzip member, so that it can be read by offset.  Of records with
equal payloads one holds the payload, the others are revisits of it.

``write_index`` sorts the captures by reversed-host URL keys and cuts them
into compressed blocks.  Each range of keys has a block file and a sparse
directory (one line a block); the first keys of the ranges are the level above.

``look_up`` finds captures by key: a binary search over the ranges, one over
the range's directory, a range read of the block, a binary search in it, and a
range read of the record.

Files go to a folder that all executors share.  A task names its files anew at
each attempt and returns their names with its rows, so files of lost attempts
are never referred to.

Defined cases: a null payload is empty; a null URL is written as
``about:blank`` and indexed under ``-``; rows without an id are captures whose
record has no id, and are all responses if no equal payload has one; rows that
repeat id and payload are the same capture, all of its kind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspan.functions.staging import shared_folder, stage

#: Bytes after which a new archive file begins, captures in an index block, and
#: blocks and archive files that a reading task keeps open.
FILE_BYTES, BLOCK_LINES, OPEN_BLOCKS, OPEN_FILES = 256 << 20, 512, 4, 64
#: Compressed bytes that a look-up task reads.
TASK_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = "key string, file string, offset bigint, length bigint"
RECORDS = (
    "page_id bigint, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, payload binary"
)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path in it."""
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def new_folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


# --- records --------------------------------------------------------------


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record; ``first`` is the id whose payload it repeats, else None."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if first is None else http
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=_IN_URI) if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        headers += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(first)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters a URI header keeps as they are.
_IN_URI = "!#$%&'()*+,-./:;=?@[]_~"


def _headers(part: bytes) -> dict[str, str]:
    lines = part.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines)


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """The columns of RECORDS; the digest of a payload is taken anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(_headers(http)["Content-Length"])
    page_id, kind = _page_of(headers["WARC-Record-ID"]), headers["WARC-Type"]
    if kind == "revisit":
        return page_id, size, declared, kind, _page_of(headers["WARC-Refers-To"]), None
    if len(payload) != size or _digest(payload) != declared:
        raise ValueError("a payload does not match its digest")
    return page_id, size, declared, kind, None, payload


# --- keys -----------------------------------------------------------------


def capture_key(url: str, page_id: str) -> Column:
    """The reversed-host key of a URL, then its id with a fixed width:
    ``org,example,blog)/en/1?page=2 09223372036854775811``."""
    after = F.regexp_replace(F.col(url), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(after, r"^[^/?#]*", 0))
    rest = F.regexp_replace(after, r"^[^/?#]*", "")
    surt = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    # the key is one line of words
    surt = F.regexp_replace(F.coalesce(surt, F.lit("-")), r"[\x00-\x20\x7f]", "%")
    number = F.expr(f"cast(cast(`{page_id}` AS decimal(20, 0)) + 9223372036854775808 AS string)")
    return F.concat_ws(" ", surt, F.coalesce(F.lpad(number, 20, "0"), F.lit("-")))


# --- writing --------------------------------------------------------------


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """Write a record for each row; the captures (CAPTURES), one per row.

    Payloads of ``least_bytes`` or more that are equal are stored once, with
    their largest id.  Only digests are aggregated; each payload is shuffled
    once, to meet the id that stores it (hot payloads: adaptive skew join).
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        capture_key(url, page_id).alias("key"),
        F.coalesce(F.col(html).cast("binary"), F.lit(bytearray())).alias("payload"),
    ).withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    stored = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("sha", "size")
        .agg(F.max("page_id").alias("stored"))
    )
    named = rows.join(stored, ["sha", "size"], "left").select(
        "page_id", "url", "key", "payload",
        F.when(F.col("page_id") != F.col("stored"), F.col("stored"))
        .when(F.col("page_id").isNull(), F.col("stored")).alias("first"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        out, lines, offset = None, [], 0

        def close() -> pa.RecordBatch:
            out.close()
            keys, offsets, lengths = zip(*lines)
            return pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(keys, pa.string()),
                    "file": pa.array([name] * len(lines), pa.string()),
                    "offset": pa.array(offsets, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                }
            )

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                number, address, key, payload, first = (c[i].as_py() for c in columns)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member
                member = packer.compress(record(number, address, payload, first))
                member += packer.flush()
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    # its members are compressed already
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    offset = 0
                out.write(member)
                lines.append((key, offset, len(member)))
                offset += len(member)
                if offset >= FILE_BYTES:
                    yield close()
                    out, lines = None, []
        if out is not None:
            yield close()

    return stage(named.mapInArrow(write, CAPTURES), "captures")


@dataclass(frozen=True)
class Index:
    """The upper level: a row for each range of keys, in their order."""

    folder: str
    first_keys: list[str]
    names: list[str]
    records: int = 0
    record_bytes: int = 0


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sort captures into blocks with a sparse directory.  The driver learns
    the first key and the name of each range, of which there are as many as
    shuffle partitions."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name, first = uuid.uuid4().hex, None
        out, lines, directory, offset = None, [], [], 0
        records = record_bytes = 0

        def close_block() -> None:
            nonlocal offset, lines
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            directory.append(f"{lines[0].rsplit('\t', 3)[0]}\t{offset}\t{len(data)}")
            offset, lines = offset + len(data), []

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for key, file, at, length in zip(*columns):
                if out is None:
                    first, out = key, system.open_output_stream(f"{path}/{name}.blocks")
                lines.append(f"{key}\t{file}\t{at}\t{length}")
                records, record_bytes = records + 1, record_bytes + length
                if len(lines) == block_lines:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            with system.open_output_stream(f"{path}/{name}.directory") as listing:
                listing.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_pydict(
                {
                    "first": [first], "last": [key], "name": [name],
                    "records": [records], "bytes": [record_bytes],
                }
            )

    ranges = (
        captures.select("key", "file", "offset", "length")
        .repartitionByRange("key", "file", "offset")
        .sortWithinPartitions("key", "file", "offset")
        .mapInArrow(write, "first string, last string, name string, records long, bytes long")
        .collect()
    )
    ranges.sort(key=lambda r: (r["first"].encode(), r["last"].encode()))
    return Index(
        folder,
        [r["first"] for r in ranges],
        [r["name"] for r in ranges],
        sum(r["records"] for r in ranges),
        sum(r["bytes"] for r in ranges),
    )


# --- reading --------------------------------------------------------------


class Reader:
    """Finds captures by key.  Holds a few blocks and files at a time."""

    def __init__(self, index: Index, archives: str):
        self.system, self.index_path = open_folder(index.folder)
        self.archives, self.archive_path = open_folder(archives)
        self.firsts = [k.encode() for k in index.first_keys]
        self.names = index.names
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()

    @staticmethod
    def _kept(store: OrderedDict, key, most: int, make):
        if key not in store:
            if len(store) >= most:
                store.popitem(last=False)
            store[key] = make()
        store.move_to_end(key)
        return store[key]

    def _directory(self, name: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        def read():
            with self.system.open_input_stream(f"{self.index_path}/{name}.directory") as data:
                rows = [line.rsplit(b"\t", 2) for line in data.read().split(b"\n")]
            return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

        return self._kept(self.directories, name, 2, read)

    def _block(self, name: str, offset: int, length: int) -> tuple[list[bytes], list[bytes]]:
        def read():
            with self.system.open_input_file(f"{self.index_path}/{name}.blocks") as data:
                lines = zlib.decompress(data.read_at(length, offset)).split(b"\n")
            return [line.rsplit(b"\t", 3)[0] for line in lines], lines

        return self._kept(self.blocks, (name, offset), OPEN_BLOCKS, read)

    def captures(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of every capture of a key."""
        shard = max(0, bisect_left(self.firsts, key) - 1)
        while shard < len(self.names) and self.firsts[shard] <= key:
            keys, places = self._directory(self.names[shard])
            for at in range(max(0, bisect_left(keys, key) - 1), bisect_right(keys, key)):
                found, lines = self._block(self.names[shard], *places[at])
                for line in lines[bisect_left(found, key) : bisect_right(found, key)]:
                    _, file, offset, length = line.rsplit(b"\t", 3)
                    yield file.decode(), int(offset), int(length)
            shard += 1

    def record(self, file: str, offset: int, length: int) -> bytes:
        source = self._kept(
            self.files, file, OPEN_FILES,
            lambda: self.archives.open_input_file(f"{self.archive_path}/{file}"),
        )
        return zlib.decompress(source.read_at(length, offset), 31)


def look_up(keys: DataFrame, index: Index, archives: str, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) of all captures of the given ``key`` column; a key
    is looked up once, however often it is given.  Keys are sorted, so that a
    task reads each directory and block about once.  ``payloads=False`` leaves
    the payload column null; every payload is read and verified all the same.

    Tasks are cut by the bytes of the records they are likely to read, as keys
    say nothing of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index, archives)
        for batch in batches:
            rows, held = [], 0
            for key in batch.column(0).to_pylist():
                for place in reader.captures(key.encode()):
                    row = parse(reader.record(*place))
                    rows.append(row if payloads else (*row[:5], None))
                    held += len(rows[-1][5] or b"")
                if held > 16 << 20 or len(rows) >= 10_000:
                    yield _record_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _record_batch(rows)

    wanted = keys.count() * index.record_bytes / max(1, index.records)
    return (
        keys.select("key").distinct()
        .repartitionByRange(int(wanted // TASK_BYTES) + 1, "key").sortWithinPartitions("key")
        .mapInArrow(read, RECORDS)
    )


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
        "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
    }
    columns = zip(*rows)
    return pa.RecordBatch.from_pydict(
        {name: pa.array(list(c), kinds[name]) for name, c in zip(kinds, columns)}
    )
