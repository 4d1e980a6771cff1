"""Secret scans, quality and toxicity."""

import base64
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakspan.llm import quality, secrets, toxicity
from cloakspan.llm.learning import is_held_out

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_texts():
    rng = random.Random(8)
    draw = lambda n, symbols: "".join(rng.choice(symbols) for _ in range(n))
    mixed = string.ascii_letters + string.digits
    texts = [
        None, "", "nothing here", "token=secret: abcdefghijkl", "PassWord = 'hunter22hunter22'",
        "toKen:abc", "apikey=12345678 api_key: \"ABCDEFGH\" API__KEY=zzzzzzzzz", "ſecret=abcdefghij",
        "AKIAAKIA AKIAABCDEFGHIJKL AKIA1", "é" * 50 + " secret=" + "ü" + " token = a.b/c+d==",
        "f" * 31 + " " + "f" * 32 + "😀" + "0" * 70, "password=" * 400, "passwd=aaaaaaaaa," * 500,
        "x " * 40_000 + "token=abcdefgh",
    ]
    texts += [f"say {draw(40, mixed)} or {draw(64, mixed + '+/')}== now" for _ in range(30)]
    texts += [f"key {draw(48, string.ascii_uppercase + '234567')}" for _ in range(10)]
    texts += ["the" * 12 + " internationalization" * 3 + " a_long_function_name_in_code" for _ in range(10)]
    texts += ["x" * 60 + " " + "abcdefgh" * 9 for _ in range(10)]
    return texts


def test_base_spans_and_discoveries(spark):
    texts = secret_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[4], "x"), (4, texts[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for r, (doc_id, text, _) in zip(secrets.scan(df.coalesce(1)).collect(), rows):
        want = base_spans(text)
        assert r["doc_id"] == doc_id
        kinds = [k for _, k, _ in want]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [kinds.count(k) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert joined(want).split(",") == [s for s in spans if not s.startswith("random")] or not want
        found = [s for s in spans if s.startswith("random")]
        assert len(found) == r["n_random"]
        if text and text.startswith("say "):
            starts = [m.start() for m in re.finditer(r"[A-Za-z0-9+/=]{30,}", text)]
            assert {int(s.split(":")[1]) for s in found} <= set(starts)
        elif text and not text.startswith("key "):
            assert not found, text[:80]
    total = secrets.scan(df).agg(F.sum("n_random")).first()[0]
    assert total >= 60  # of 70 random tokens
    assert secrets.scan(df.limit(0)).count() == 0


def test_redaction_removes_every_span(spark):
    texts = secret_texts()
    df = spark.createDataFrame(
        [(i, t, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row string, secret_spans int"
    )
    got = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert secrets.redact(df).columns == df.columns
    for i, text in enumerate(texts):
        assert got[i]["row"] == text and got[i]["secret_spans"] == i
        assert text is None or base_spans(got[i]["text"]) == []
        if text is None or not (base_spans(text) or text[:4] in ("say ", "key ")):
            assert got[i]["text"] == text
    assert got[3]["text"] == "token=secret: abcdefghijkl"
    assert got[4]["text"] == "[SECRET]'"
    assert got[9]["text"].startswith("é" * 50 + " secret=ü [SECRET]")


def test_random_tokens_pass_the_battery_and_words_do_not(spark):
    rng = random.Random(3)
    symbols = string.ascii_letters + string.digits + "+/"
    tokens = ["".join(rng.choice(symbols) for _ in range(40)) + "a" for _ in range(300)]
    words = base64.b64encode(b"\0" * 40).decode().rstrip("="), "onetwothreefourfivesixseveneightnine", "ab" * 20
    df = spark.createDataFrame([(t,) for t in [*tokens, *words]], "t string")
    rows = df.select(F.expr(secrets._battery("t")).alias("b")).select("b.*").collect()
    level = secrets.BATTERY_LEVEL
    assert sum(r["p_random"] >= level for r in rows[:300]) >= 295
    assert all(r["p_text"] < 0.01 for r in rows[:300])
    assert all(r["p_random"] < level or r["p_text"] > 0.1 for r in rows[300:])


# --- classifiers ----------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(4)
    return docs, spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(tables, module, label, least):
    docs, labels = tables
    model = module.train(docs, labels)
    scored = module.score(docs, model)
    assert scored.count() == docs.count()
    wide = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= wide[0] <= wide[1] <= 1
    held = scored.join(labels, "doc_id").where("held_out")
    right, ranked = held.agg(
        F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")
    ).first()
    assert ranked > 100 and right >= least
    low, high = (
        held.where(F.col(label) == v).agg(F.expr("percentile(score, 0.5)")).first()[0] for v in (0, 1)
    )
    assert low < high


def test_quality_cut_covers_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 20, raising=False)
    monkeypatch.setattr(quality, "BINS", 8, raising=False)
    rng = random.Random(6)
    rows = []
    for i in range(1_200):
        words = ["word" + "s" * rng.randrange(9) for _ in range(rng.randrange(5, 60))]
        good = rng.random() < 0.3
        marks = ["!!", "##", "7"] * rng.randrange(3 if good else 9)
        rows.append((i, " ".join(words + marks), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.train(docs, labels, per_class=30)
    learned = [(t, q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    strengths = np.sort(model.strength(np.array([quality.measures(t) for t, _ in learned])))
    bad = sum(1 - q for _, q in learned)
    assert model.cut == pytest.approx((strengths[bad - 1] + strengths[bad]) / 2, abs=1e-12)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_tables(spark, module, label):
    texts = [None, "", "   ", "idiot", "a fine text. " * 9, "\x00\U0001f600" * 50, "word " * 50_000]
    docs = spark.createDataFrame(
        [(i, t, 0.5, 1) for i, t in enumerate(texts)] + [(None, "x", 0.5, 1), (3, "idiot", 0.5, 1)],
        "doc_id long, text string, score double, label int",
    )
    marks = [(i, i % 2, (i + 1) % 2) for i in range(7)] + [(None, 1, 1), (2, 1, None), (4, None, 5), (4, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where(f"{label} = 1"), labels.where(f"{label} = 0")):
        model = module.train(docs, known)
        rows = module.score(docs, model).collect()
        assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
        same = [r["score"] for r in rows if r["doc_id"] == 3]
        assert len(same) == 2 and same[0] == same[1]
    assert module.score(docs.limit(0), model).count() == 0
    if module is quality:
        assert quality.keep(docs, quality.train(docs, labels.limit(0))).count() == 9


def test_a_document_given_often_is_learned_once(spark):
    from cloakspan.llm.learning import labelled_sample

    docs = spark.range(3_000).selectExpr(
        "if(id % 3 = 0, 1, id) AS doc_id", "concat('text ', 5000 + id) AS text", "1 AS label"
    )
    labels = spark.range(3_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    sample, share = labelled_sample(docs, labels, "quality", 40)
    rows = sample.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) <= 80 and 0.4 < share < 0.6
    assert {r["text"] for r in rows if r["doc_id"] == 1} <= {"text 5000"}


def test_held_out_rows_follow_the_rule(spark):
    import zlib

    df = spark.range(200).select(F.col("id").alias("doc_id"))
    for r in df.select("doc_id", is_held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
