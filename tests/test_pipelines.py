"""Sources, tables, entities, learning, sessions and streams."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cloakspan.operators.crypto import Keyring
from cloakspan.operators.detect import Detector, raw_spans
from cloakspan.operators.dictionary import dictionary_spans
from cloakspan.operators.entities import clean_entity, with_entities
from cloakspan.operators.learning import (
    apply_feedback,
    export_learned,
    learn_pii,
    learn_safe,
    pattern_rules,
    read_learned,
    read_learned_object,
)
from cloakspan.operators.redact import Layers, table_spans, unit_spans
from cloakspan.operators.review import as_decisions, review_queue, unknown_answers
from cloakspan.plans.corpus import redact_corpus, restore_corpus
from cloakspan.plans.sessions import drop_expired, open_sessions
from cloakspan.sources.files import (
    list_files,
    read_text_files,
    redacted_name,
    restored_name,
    route_files,
    write_texts,
)
from cloakspan.sources.tables import redact_table, restore_table
from cloakspan.sources.units import join_units, whole_units
from cloakspan.streaming.sessions import batch_writer, live_hours, read_mapping


def units_of(spark, *texts):
    return whole_units(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    )


# -- files -----------------------------------------------------------------------------


def test_files_are_listed_routed_and_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.MD").write_bytes("über\r\nzwei\rdrei\n".encode())
    (tmp_path / "in" / "b.csv").write_text("x")
    routed = {
        r["path"].rsplit("/", 1)[1]: (r["extension"], r["family"], r["error"])
        for r in route_files(list_files(spark, f"{tmp_path}/in")).collect()
    }
    assert routed["a.MD"] == (".md", "text", None)
    assert routed["b.csv"] == (".csv", None, "unsupported file type: .csv")
    hidden = spark.createDataFrame([("/in/.bashrc",)], "path string")
    assert tuple(route_files(hidden).first())[1:3] == ("", None)
    text = read_text_files(spark, f"{tmp_path}/in/a.MD").first()["text"]
    assert text == "über\nzwei\ndrei\n"


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


@pytest.mark.parametrize("path,redacted,restored", [
    ("/a.b/c.txt", "/a.b/c_redacted.txt", "/a.b/c_restored.txt"),
    ("/a.b/c", "/a.b/c_redacted", "/a.b/c_restored"),
    ("c_redacted.md", "c_redacted_redacted.md", "c_restored.md"),
    ("/x/.env", "/x/.env_redacted", "/x/.env_restored"),
])
def test_output_names(spark, path, redacted, restored):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(redacted_name(F.col("p")), restored_name(F.col("p"))).first()) == (
        redacted, restored,
    )


def test_written_texts_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "one\ntwo"), ("b.txt", "")], "n string, t string")
    write_texts(df, f"{tmp_path}/out", "t", F.col("n"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


# -- dictionaries ------------------------------------------------------------------------


def test_dictionary_table_equals_the_small_dictionary(spark):
    values = [("person_name", "Ann"), ("custom", "x"), ("nickname", "a.b"), ("email", "ANN@x.io"),
              ("team_name", "Ünal Straße"), ("url", "😀 ok"), ("custom", "aa")]
    texts = ["ann ANNUAL ann@x.io a.b aab", "ünal straße and ÜNAL STRASSE 😀 OK x", "none",
             "aaaa X.x", "a\nb Ann"]
    units = units_of(spark, *texts)
    table = spark.createDataFrame(values, "pii_type string, value string")
    fields = ["doc_id", "start", "end", "text", "pii_type"]
    got = {tuple(r) for r in dictionary_spans(units, table).select(*fields).collect()}
    detector = Detector(rules=(), names=False).with_learned(pii=values)
    small = units.withColumnRenamed("text", "body").select(
        "doc_id", F.expr(f"inline({raw_spans('body', detector)})")
    )
    assert got == {tuple(r) for r in small.select(*fields).collect()}
    assert len(got) > 8


def test_case_blind_values_equal_python(spark):
    values = ["mask", "\u039f\u0394\u039f\u03a3", "Istanbul", "gro\u00df", "\u2126hm", "\u00b5m"]
    texts = ["MA\u017f\u212a Mask", "\u03bf\u03b4\u03bf\u03c3\u03b1 \u03bf\u03b4\u03bf\u03c2",
             "\u0131stanbul \u0130STANBUL", "GRO\u1e9e GROSS", "\u03c9hm \u03a9HM", "\u03bcM \u039cm"]
    table = spark.createDataFrame([("custom", v) for v in values], "pii_type string, value string")
    units = units_of(spark, *texts)
    want = {
        (i, *m.span()) for i, t in enumerate(texts) for v in values
        for m in re.finditer(re.escape(v), t, re.I)
    }
    got = dictionary_spans(units, table).select("doc_id", "start", "end")
    assert {tuple(r) for r in got.collect()} == want
    detector = Detector(rules=(), names=False).with_learned(pii=[("custom", v) for v in values])
    small = units.withColumnRenamed("text", "body").select(
        "doc_id", F.expr(f"inline({raw_spans('body', detector)})")
    )
    assert {tuple(r) for r in small.select("doc_id", "start", "end").collect()} == want


def test_learned_values_ignore_the_safe_table(spark):
    units = units_of(spark, "Ann Lee met ann@x.io and Bo Ray")
    learned = spark.createDataFrame([("person_name", "Ann Lee")], "pii_type string, value string")
    safe = spark.createDataFrame([("ann lee",), ("bo ray",)], "value_lc string")
    got = table_spans(units, Detector(), learned, safe).orderBy("start").collect()
    assert [(r["text"], r["layer"]) for r in got] == [("Ann Lee", 1), ("ann@x.io", 2)]


def test_many_inline_values_equal_the_table(spark):
    """No number of values is refused, and their order decides in both forms."""
    pii = [("custom", f"v{i}v") for i in range(700)] + [("team_name", "Zorkon"), ("company_name", "zorkon")]
    units = units_of(spark, "v1v V699V v700v", "ZORKON zorkon")
    detector = Detector(rules=(), names=False).with_learned(
        pii=pii, safe=[f"s{i}" for i in range(10_100)]
    )
    table = spark.createDataFrame([(*p, i) for i, p in enumerate(pii)], "pii_type string, value string, rank int")
    keep = ["doc_id", "start", "end", "pii_type"]
    inline = unit_spans(units, detector).select(*keep)
    joined = unit_spans(units, Detector(rules=(), names=False), layers=Layers(dictionary=table)).select(*keep)
    want = {(0, 0, 3, "custom"), (0, 4, 9, "custom"), (1, 0, 6, "team_name"), (1, 7, 13, "team_name")}
    assert {tuple(r) for r in inline.collect()} == want
    assert {tuple(r) for r in joined.collect()} == want


# -- entities -----------------------------------------------------------------------------


@pytest.mark.parametrize("label,text,want", [
    ("PERSON", " Mary Baker - sales", "Mary Baker"),
    ("PERSON", "mary baker", "mary baker"),
    ("PERSON", "One Two Three Four", None),
    ("PERSON", "one two three four", None),
    ("PERSON", "Олена Бондар\nx", "Олена Бондар"),
    ("ORG", "Acme Corp\nStreet", "Acme Corp"),
    ("ORG", "Project Falcon", None),
    ("ORG", "Client  Big Tech", "Big Tech"),
    ("ORG", "projecting things", "projecting things"),
    ("ORG", "Details", None),
    ("ORG", "host 10.0.0.7 x", None),
    ("GPE", " X ", None),
    ("GPE", "Kyiv", "Kyiv"),
    ("MONEY", "ten dollars", None),
    ("DATE", "договір", None),
])
def test_entity_clean_up(spark, label, text, want):
    df = spark.createDataFrame([(label, text)], "l string, t string")
    assert df.select(F.expr(clean_entity("l", "t"))).first()[0] == want


def test_entity_of_a_claimed_span_is_dropped(spark):
    text = "Ask ann@corp.io or Mary Baker Jones now"
    units = units_of(spark, text)
    entities = spark.createDataFrame(
        [(0, 0, "PERSON", 4, 15), (0, 0, "PERSON", 19, 35)],
        "doc_id long, unit_no int, label string, start int, end int",
    )
    attached = with_entities(units, entities, ["doc_id", "unit_no"])
    got = unit_spans(attached, entities="entities").orderBy("start", "end").collect()
    assert [(r["text"], r["rule"], r["status"]) for r in got] == [
        ("ann@corp.io", "email", "match"),
        ("Mary Baker", "name_bigram", "uncertain"),
        ("Mary Baker Jones", "entity", "match"),
    ]


# -- learning -------------------------------------------------------------------------------


def replay(pii, safe, decisions):
    pii, safe = set(pii), set(safe)
    for kind, value, decision in decisions:
        if decision == "yes":
            pii.add((kind, value))
            safe.discard(value.lower())
        elif decision == "no":
            safe.add(value.lower())
            pii = {(k, v) for k, v in pii if v not in (value, value.lower())}
    return pii, safe


def test_feedback_equals_a_replay(spark):
    import random

    rng = random.Random(4)
    words = ["Ann", "ann", "ANN", "Bo", "bo", "Cy"]
    kinds = ["person_name", "team_name"]
    for _ in range(4):
        pii = {(rng.choice(kinds), rng.choice(words)) for _ in range(3)}
        safe = {rng.choice(words).lower() for _ in range(2)}
        said = [(rng.choice(kinds), rng.choice(words), rng.choice(["yes", "no", "skip"]))
                for _ in range(12)]
        rows = [(k, v, d, None, i) for i, (k, v, d) in enumerate(said)]
        new_pii, new_safe = apply_feedback(
            spark.createDataFrame(list(pii), "pii_type string, value string"),
            spark.createDataFrame([(s,) for s in safe], "value_lc string"),
            spark.createDataFrame(
                rows, "pii_type string, value string, decision string, "
                "type_override string, decided_at int"),
        )
        got = {tuple(r) for r in new_pii.collect()}, {r[0] for r in new_safe.collect()}
        assert got == replay(pii, safe, said)


def test_learning_one_side_clears_the_other(spark):
    pii = spark.createDataFrame([("a", "Ann"), ("b", "ann"), ("b", "ANN")], "pii_type string, value string")
    safe = spark.createDataFrame([("bo",)], "value_lc string")
    new = spark.createDataFrame([("c", "BO")], "pii_type string, value string")
    got_pii, got_safe = learn_pii(pii, safe, new)
    assert ("c", "BO") in {tuple(r) for r in got_pii.collect()} and got_safe.count() == 0
    got_pii, got_safe = learn_safe(pii, safe, spark.createDataFrame([("Ann",)], "value string"))
    assert {tuple(r) for r in got_pii.collect()} == {("b", "ANN")}
    assert {r[0] for r in got_safe.collect()} == {"bo", "ann"}


def test_learned_files(spark, tmp_path):
    (tmp_path / "learned.json").write_text(json.dumps({
        "version": 1, "pii": {"email": ["a@b.io", "c@d.io"], "custom": ["x"]}, "safe": ["ok"],
        "custom_patterns": {"badge": {"pattern": "B[0-9]+", "pii_type": "badge",
                                      "created_at": "2024-01-02T03:04:05"}},
        "metadata": {"exported_at": "2024-01-02T03:04:05"},
    }, indent=2))
    pii, safe, patterns = read_learned_object(spark, f"{tmp_path}/learned.json")
    assert {tuple(r) for r in pii.collect()} == {
        ("email", "a@b.io"), ("email", "c@d.io"), ("custom", "x")}
    rule = pattern_rules(patterns)[0]
    assert (rule.name, rule.pii_type, rule.pattern, rule.confidence) == ("badge", "custom", "B[0-9]+", 0.9)
    export_learned(pii, safe, f"{tmp_path}/rows", patterns)
    again = read_learned(spark, f"{tmp_path}/rows")
    for before, after in zip((pii, safe, patterns), again):
        assert before.exceptAll(after.select(*before.columns)).count() == 0


# -- tables ----------------------------------------------------------------------------------


def test_table_keeps_schema_and_other_columns(spark):
    df = spark.createDataFrame(
        [(1, "mail ann@x.io", 7, None, "Ann@x.io"), (2, "   ", 8, "10.0.0.7", "none"),
         (3, "bo@x.io ann@x.io", None, "", None)],
        "id long, a string, n int, `b c` string, d string",
    )
    redacted, mapping = redact_table(df, "id")
    assert redacted.schema == df.schema or redacted.columns == df.columns
    got = {r["id"]: tuple(r)[1:] for r in redacted.collect()}
    assert got == {
        1: ("mail person1@example.com", 7, None, "person1@example.com"),
        2: ("   ", 8, "192.0.2.1", "none"),
        3: ("person2@example.com person1@example.com", None, "", None),
    }
    restored, counts = restore_table(redacted, "id", mapping)
    assert {r["id"]: r["a"] for r in restored.collect()}[3] == "bo@x.io ann@x.io"
    assert {r["id"]: r["restorations"] for r in counts.collect()} == {1: 2, 2: 1, 3: 2}


def test_corpus_written_and_restored(spark, tmp_path):
    docs = spark.createDataFrame(
        [("d1", "Hi ann@x.io\nand 10.0.0.7"), ("d2", "ann@x.io\n\nbye")],
        "doc_id string, text string",
    )
    keyring = Keyring.from_password(spark, "pw", rounds=100)
    redact_corpus(docs, f"{tmp_path}/out", keyring, scope="corpus")
    texts = spark.read.parquet(f"{tmp_path}/out/texts")
    seen = {r["doc_id"]: r["text"] for r in texts.collect()}
    assert seen["d2"].split("\n")[0] == "person1@example.com" and "ann@" not in str(seen)
    report = {r["doc_id"]: (r["total"], r["n_units"], r["by_type"]) for r in
              spark.read.parquet(f"{tmp_path}/out/report").collect()}
    assert report == {"d1": (2, 2, {"email": 1, "ip_address": 1}), "d2": (1, 3, {"email": 1})}
    left = restore_corpus(
        texts, f"{tmp_path}/out/mapping", f"{tmp_path}/back", "pw", rounds=100, scope="corpus"
    )
    back = spark.read.parquet(f"{tmp_path}/back")
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {
        r["doc_id"]: r["text"] for r in docs.collect()}
    assert left.count() == 0


def test_units_join_in_order(spark):
    units = spark.createDataFrame(
        [("d", i, str(i)) for i in (2, 10, 0, 1, 9)], "doc_id string, unit_no int, text string"
    )
    assert join_units(units, ",").first()["text"] == "0,1,2,9,10"


# -- sessions and streams ------------------------------------------------------------------------


def test_unknown_answers_are_named(spark):
    queue = review_queue(unit_spans(units_of(spark, "Mary Baker met Bo Ray")))
    answers = spark.createDataFrame(
        [(0, 0, "yes", None, 1), (0, 7, "yes", None, 2)],
        "scope_id long, idx int, decision string, type_override string, decided_at int",
    )
    assert as_decisions(queue, answers).first()["value"] == "Mary Baker"
    assert unknown_answers(queue, answers).first()["idx"] == 7


def test_expiry_keeps_the_last_moment(spark):
    start = datetime(2024, 1, 1)
    texts = spark.createDataFrame(
        [("a", start), ("a", start + timedelta(hours=5)), ("b", start - timedelta(seconds=1))],
        "s string, ts timestamp",
    )
    mapping = spark.createDataFrame([("a", "x"), ("b", "y")], "scope_id string, placeholder string")
    live, kept = drop_expired(
        mapping, open_sessions(texts, "s", F.col("ts")), F.lit(start + timedelta(hours=1))
    )
    assert [r["session_id"] for r in live.collect()] == ["a"]
    assert [r["scope_id"] for r in kept.collect()] == ["a"]


def batch(spark, *rows):
    start = datetime(2024, 1, 1, 10, 50)
    return spark.createDataFrame(
        [(s, start + timedelta(minutes=m), n, t) for s, m, n, t in rows],
        "session_id string, ts timestamp, unit_no int, text string",
    )


def test_repeated_batch_changes_nothing(spark, tmp_path):
    keyring = Keyring.from_key(spark, b"k" * 32)
    write = batch_writer(f"{tmp_path}/map", f"{tmp_path}/out", keyring)
    first = batch(spark, ("s", 0, 0, "ann@x.io bo@x.io"), ("t", 1, 0, "bo@x.io"))
    second = batch(spark, ("s", 30, 1, "cy@x.io ANN@x.io"), ("u", 31, 0, "no values"))
    late = batch(spark, ("s", 61, 2, "bo@x.io"), ("t", 61, 1, "bo@x.io"))
    write(first, 0)
    write(second, 1)

    def state():
        out = spark.read.parquet(f"{tmp_path}/out").orderBy("session_id", "unit_no")
        marks = read_mapping(spark, f"{tmp_path}/map").select("scope_id", "placeholder")
        return [r["redacted"] for r in out.collect()], sorted(map(tuple, marks.collect()))

    before = state()
    assert before[0] == [
        "person1@example.com person2@example.com", "person3@example.com person1@example.com",
        "person1@example.com", "no values",
    ]
    write(second, 1)
    assert state() == before
    # an hour after its first text a session is new again; one at the limit is not
    write(late, 2)
    texts = {(r["session_id"], r["unit_no"]): (r["redacted"], r["scope_id"])
             for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert texts[("s", 2)][0] == "person1@example.com"
    assert texts[("t", 1)] == ("person1@example.com", texts[("t", 0)][1])
    known = read_mapping(spark, f"{tmp_path}/map")
    assert known.where("session_id = 't'").count() == 1
    # the reopened session has a key of its own, so no placeholder stands twice
    assert texts[("s", 2)][1] != texts[("s", 0)][1] == texts[("s", 1)][1]
    assert known.groupBy("scope_id", "placeholder").count().where("count > 1").count() == 0


def test_only_live_hours_are_read(spark, tmp_path):
    from datetime import datetime

    assert live_hours(datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1, 1, 0)) == [
        "2023-12-31-23", "2024-01-01-00", "2024-01-01-01",
    ]
    assert read_mapping(spark, f"{tmp_path}/none").count() == 0
    assert read_mapping(spark, f"{tmp_path}/none", ["2024-01-01-00"]).count() == 0
