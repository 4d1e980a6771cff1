"""Files cut into units: the spans are those of the whole file."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from cloakspan.functions.staging import shared_folder
from cloakspan.operators.crypto import Keyring
from cloakspan.operators.detect import Detector, detect_spans
from cloakspan.plans.corpus import redact_files
from cloakspan.sources.large_files import (
    CONTEXTUAL_SEAM,
    file_spans,
    read_file_units,
    seam_of,
    write_file_units,
)


@pytest.fixture
def small_blocks(spark):
    """Blocks of 97 bytes, so that every kind of hit meets their borders."""
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _text(seed: int, n: int = 260) -> str:
    """Lines in which values, names and blank lines stand across line ends."""
    draw = random.Random(seed)
    words = [
        "415", "555", "1234", "(415)", "+1", "12", "4000", "5678", "9010", "Mary", "Baker", "Élan",
        "Ivan", "end.", "so,", "é", "mail a@b.org", "10.0.0.7", "@dev_1", "https://x.io/p", "word",
        "Mr:", "team", "from",
    ]
    ends = [" ", " ", "\n", "\n", "\r\n", "\n\n", "\n \t\n", "\r", "\n\n\n\n", "\x1c\n"]
    return "".join(draw.choice(words) + draw.choice(ends) for _ in range(n)).rstrip() + "."


def _write(tmp_path, texts: dict[str, str]) -> str:
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def _plain(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _joined(units) -> dict[str, str]:
    rows = sorted(units.select("doc_id", "unit_no", "start", "text").collect())
    out: dict[str, str] = {}
    for doc_id, _, start, text in rows:
        name = doc_id.rsplit("/", 1)[1]
        assert start == (len(out[name]) + 1 if name in out else 0)
        out[name] = f"{out[name]}\n{text}" if name in out else text
    return out


@pytest.mark.parametrize("contextual", [(), ("person_name", "team_name")])
def test_spans_are_those_of_the_whole_file(spark, tmp_path, small_blocks, contextual):
    texts = {f"{i}.txt": _text(i) for i in range(6)}
    detector = Detector(contextual=contextual)
    path = _write(tmp_path, texts)
    units = read_file_units(spark, path, seam=seam_of(detector), unit_chars=50).cache()
    assert _joined(units) == {k: _plain(v) for k, v in texts.items()}
    assert units.groupBy("doc_id").count().where("count < 10").isEmpty()
    found = file_spans(units, detector).selectExpr(
        "regexp_extract(doc_id, '([^/]*)$', 1) AS name", "start", "end", "text", "rule"
    )
    whole = spark.createDataFrame([(k, _plain(v)) for k, v in texts.items()], "name string, text string")
    wanted = whole.select("name", F.expr(f"inline({detect_spans('text', detector)})")).selectExpr(
        "name", "cast(start AS bigint) AS start", "cast(end AS bigint) AS end", "text", "rule"
    )
    got, want = sorted(map(tuple, found.collect())), sorted(map(tuple, wanted.collect()))
    assert got == want
    assert any("\n" in row[3] for row in got)


def test_a_hit_on_every_border(spark, tmp_path, small_blocks):
    """The same number, moved by one byte from file to file past two blocks."""
    texts = {f"{i:03}.txt": "x" * i + ".\n415\n555\n1234\n" + "tail line.\n" * 12 for i in range(0, 200, 3)}
    units = read_file_units(spark, _write(tmp_path, texts), unit_chars=40)
    rows = file_spans(units, Detector(names=False)).where("rule = 'phone'").collect()
    got = {(r.doc_id.rsplit("/", 1)[1], r.start, r.text) for r in rows}
    assert got == {(f"{i:03}.txt", i + 2, "415\n555\n1234") for i in range(0, 200, 3)}


def test_odd_files(spark, tmp_path, small_blocks):
    texts = {
        "empty.txt": "", "blank.txt": "\n" * 300, "one.txt": "no line end", "seams.txt": "123\n" * 200 + "9",
        "late.txt": "\n" * 250 + "415\n" + " \n" * 150 + "555",
    }
    joined = _joined(read_file_units(spark, _write(tmp_path, texts), unit_chars=20))
    # a file of line ends has a line less than it has ends
    assert joined == {k: v[:-1] if k == "blank.txt" else v for k, v in texts.items() if v}


def test_unknown_seams_are_refused():
    assert seam_of(Detector(contextual=("team_name",))) == CONTEXTUAL_SEAM
    with pytest.raises(ValueError):
        seam_of(Detector().with_custom_pattern("a b"))


def test_files_are_written_in_order(spark, tmp_path, small_blocks):
    source = tmp_path / "in"
    source.mkdir()
    texts = {f"{i}.txt": _text(i) for i in range(2)}
    units = read_file_units(spark, _write(source, texts), unit_chars=60)
    write_file_units(units, str(tmp_path / "out"))
    for folder in (tmp_path / "out").glob("file=*"):
        parts = sorted(folder.glob("part-*"))
        text = b"".join(p.read_bytes() for p in parts).decode()
        assert text == _plain(texts[folder.name[-5:]]) + "\n"


def test_files_are_redacted_with_one_mapping_each(spark, tmp_path, small_blocks):
    source = tmp_path / "in"
    source.mkdir()
    line = "Mail mary@corp.io, or call 415-555-0100.\n"
    path = _write(source, {"a.txt": line * 40, "b.txt": line * 3})
    out = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    redact_files(spark, [path], out, Keyring.from_key(spark, b"k" * 32), unit_chars=80)
    texts = spark.read.text(f"{out}/texts").groupBy("value").count().collect()
    assert [(r["value"], r["count"]) for r in texts] == [
        ("Mail person1@example.com, or call 555-000-0001.", 43)
    ]
    report = spark.read.parquet(f"{out}/report")
    assert report.count() == 2


def test_a_folder_of_part_files_is_one_file(spark, tmp_path):
    docs = spark.range(200).selectExpr(
        "id AS doc_id", "if(id < 150, 'a', 'b') AS lang",
        "concat('mail x', id, '@corp.io', if(id % 3 = 0, ' call 415', ''), if(id % 3 = 1, '555-', '')) AS text",
    )
    path = str(tmp_path / "parts")
    ordered = docs.repartitionByRange(7, "lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    ordered.select("lang", "text").write.partitionBy("lang").text(path)
    units = read_file_units(spark, path, unit_chars=60, folders=True)
    whole = {lang: "\n".join(r["text"] for r in docs.where(f"lang = '{lang}'").orderBy("doc_id").collect()) for lang in "ab"}
    assert len(list((tmp_path / "parts" / "lang=a").glob("part-*"))) > 2
    assert {r["doc_id"].rsplit("=")[-1] for r in units.select("doc_id").distinct().collect()} == {"a", "b"}
    for r in units.collect():
        text = whole[r["doc_id"].rsplit("=")[-1]]
        assert text[r["start"]:].startswith(r["text"])
    sizes = units.selectExpr("doc_id", "length(text) + 1 AS n").groupBy("doc_id").sum("n").collect()
    assert {r[0].rsplit("=")[-1]: r[1] - 1 for r in sizes} == {k: len(v) for k, v in whole.items()}
