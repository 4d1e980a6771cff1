"""WARC index, top-k search and URL filter on small tables."""

import base64
import gzip
import hashlib
import math
import random
from collections import defaultdict

import duckdb
import pytest

from cloakspan.llm import topk, url_filter, warc
from cloakspan.llm.queries import ORACLES, QUERIES


@pytest.fixture
def pages(spark):
    rows = [
        (1, "http://a.example.org/x?q=1", "<p>one</p>"),
        (2, "https://b.example.org/é y", "<p>one</p>"),
        (3, None, None),
        (4, "no scheme", ""),
        (7, "http://a.example.org/x?q=1", "ü" * 100_000),
        (7, "http://a.example.org/x?q=1", "ü" * 100_000),
        (9, "http://user@Host:80\n/#f", "a\r\n\r\nb\x00"),
        (None, "http://none/", "only here"),
        (None, "http://none/", "<p>one</p>"),
        *[(100 + i, f"http://h{i % 7}.net/p/{i}", f"page {i % 50}") for i in range(700)],
    ]
    schema = "page_id long, url string, html string"
    return spark.createDataFrame([(*r, "x") for r in rows], schema + ", key string"), rows


def wanted_records(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1(h).digest()).decode()
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, payload in payloads:
        if i is not None:
            top[payload] = max(top.get(payload, i), i)
    want = []
    for i, payload in payloads:
        first = top.get(payload)
        again = first is not None and i != first
        want.append((i, len(payload), digest(payload), "revisit" if again else "response", first if again else None))
    return want


def test_archives_are_found_through_the_index(spark, pages, monkeypatch):
    df, rows = pages
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    archives, folder = warc.new_folder(df, "warc"), warc.new_folder(df, "index")
    captures = warc.write_archives(df.repartition(3), archives)
    assert captures.count() == len(rows)
    index = warc.write_index(captures, folder, block_lines=5)
    keys = df.select(warc.capture_key("url", "page_id").alias("key"))
    got = warc.look_up(keys, index, archives).collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, wanted_records(rows)))
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"])
    one = df.where("page_id = 105").select(warc.capture_key("url", "page_id").alias("key"))
    assert [r["page_id"] for r in warc.look_up(one, index, archives).collect()] == [105]
    missing = spark.createDataFrame([("zzz",), ("",), ("net,h1)/p/1",)], "key string")
    assert warc.look_up(missing, index, archives).count() == 0


def test_archives_are_ordinary_gzip_files(spark, pages):
    df, rows = pages
    archives = warc.new_folder(df, "warc")
    captures = warc.write_archives(df, archives)
    system, path = warc.open_folder(archives)
    whole = b""
    for name in {r["file"] for r in captures.collect()}:
        with system.open_input_file(f"{path}/{name}") as data:
            whole += gzip.decompress(data.read())
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    assert b"WARC-Target-URI: about:blank\r\n" in whole


def test_small_payloads_are_all_stored(spark, pages):
    df, _ = pages
    archives = warc.new_folder(df, "warc")
    index = warc.write_index(warc.write_archives(df, archives, least_bytes=9), warc.new_folder(df, "i"))
    keys = df.select(warc.capture_key("url", "page_id").alias("key"))
    got = warc.look_up(keys, index, archives, payloads=False).collect()
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 9)
    assert any(r["record_type"] == "revisit" for r in got)
    empty = df.limit(0)
    none = warc.write_index(warc.write_archives(empty, archives), warc.new_folder(df, "i"))
    assert none.names == [] and warc.look_up(keys, none, archives).count() == 0


# --- top-k ----------------------------------------------------------------


def brute_top(rows, k):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(64 * x) for x in v]))
    answers = defaultdict(list)
    for i, q in whole:
        if i % 20 == 0:
            answers[i] += [(-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i]
    found = []
    for i, scores in answers.items():
        found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(found)


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "STRIP", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "AT_ONCE", 3)
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 0.1), 2) * scale for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5 * scale] + [0.0] * 5) for i in range(300, 340)]  # ties
    rows += [(400, None), (420, [float("nan")] * 6), (440, [None, 1.0]), (None, [1.0]), (460, [])]
    rows += [(480, [0.1 * scale]), rows[3], rows[20], (20, [0.3 * scale] * 6), (481, [float("inf")])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    vectors = topk.integer_vectors(df.repartition(3), "vec_id", "embedding", 64)
    got = sorted(map(tuple, topk.search(vectors, vectors.id % 20 == 0, k=20).collect()))
    assert got == brute_top(rows, 20)
    assert topk.search(vectors.limit(0), vectors.id % 20 == 0).count() == 0


def test_repeated_queries_answer_as_the_sql(spark, tmp_path):
    """Rows that share an id, some of them equal, all ask."""
    rng = random.Random(5)
    rows = [(i // 3, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(180)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(base.execute(ORACLES["op3_topk"]).fetchall())
    assert sorted(map(tuple, QUERIES["op3_topk"](spark, str(tmp_path)).collect())) == want


def test_look_ups_are_cut_by_the_bytes_they_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 2_000)
    html = [str(random.Random(i).getrandbits(4_000)) for i in range(60)]
    rows = [(i, f"http://h{i}.org/", text) for i, text in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.new_folder(pages, "warc")
    index = warc.write_index(
        warc.write_archives(pages, archives), warc.new_folder(pages, "capture-index")
    )
    assert index.records == 60 and index.record_bytes > 20_000
    keys = pages.select(warc.capture_key("url", "page_id").alias("key"))
    found = warc.look_up(keys, index, archives)
    assert found.rdd.getNumPartitions() >= 10 and found.count() == 60
    assert warc.look_up(keys.limit(1), index, archives).rdd.getNumPartitions() == 1


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(df, "vec_id", "embedding", 64)
    got = topk.search(vectors, vectors.id % 20 == 0, k=20).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 8192), (0, 2, 2, 8192)]


# --- URL filter -----------------------------------------------------------

RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "com", "/de/"),
)


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://anexample.org/es/", "anexample.org", "/es/", "org/", "allow"),
        ("x://org/", "org", "/", "org/", "allow"),
        ("http://org", "org", "", None, None),
        ("http://h?//p/", "h", "", None, None),
        ("http://h#/p", "h", "", None, None),
        ("a://b://c.com/de/", "b:", "//c.com/de/", None, None),
        ("http://ÄB.com/de/\n2", "Äb.com", "/de/\n2", "com/de/", "block"),
        ("no scheme", "", "", None, None),
        ("://", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    df = spark.createDataFrame([(c[0], 1) for c in cases], "url string, host int")
    rows = url_filter.with_rule(df, RULES).collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["rule_verdict"]) for r in rows] == cases
    model = url_filter.train(url_filter.with_rule(df, RULES).selectExpr("host", "path", "rule_verdict AS verdict"))
    pages = df.selectExpr("cast(NULL AS bigint) AS page_id", "url", "1 AS score")
    judged = url_filter.judge(pages, RULES, model).collect()
    assert [r["rule"] for r in judged] == [c[3] for c in cases]
    assert all(r["verdict"] == c[4] for r, c in zip(judged, cases) if c[4])
    assert {r["verdict"] for r in judged} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0), RULES, model).count() == 0


def test_url_model_learns_and_defaults(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        bad = i % 2 == 0
        host = rng.choice(["free-bets", "ads-track", "casino"] if bad else ["news", "library", "school"])
        rows.append((f"{host}{rng.randrange(50)}.net", f"/{rng.randrange(9_999)}", "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "host string, path string, verdict string")
    model = url_filter.train(df.limit(400))
    right = [(model.score(h, p) >= 0.5) == (v == "block") for h, p, v in rows[400:]]
    assert sum(right) / len(right) > 0.97
    assert url_filter.train(df.where("verdict = 'block'")).score("x", "/") > 0.5
    assert url_filter.train(df.limit(0)).score("x", "/") < 0.5
