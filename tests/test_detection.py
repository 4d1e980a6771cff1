"""Detection and arbitration against golden texts and the Python model."""

import random
import re

import pytest
from pyspark.sql import functions as F

import twin
from checks.inputs import RICH_TEXT, derived
from cloakspan import rules as R
from cloakspan.functions.spans import FENCE, context_of, regex_hits
from cloakspan.functions.expr import text_literal
from cloakspan.operators.detect import (
    SPAN_FIELDS,
    Detector,
    contextual_spans,
    detect_spans,
    rule_hits,
)
from cloakspan.operators.redact import Policy, found_spans, unit_spans
from cloakspan.sources.units import whole_units

GOLDEN = {
    "G1": "Write to ann.lee@corp.io or bob@corp.io.",
    "G2": "Call 415-555-0134 or 1-800-555-0111.",
    "G3": "Ping @dev_ops, @qa and @lead.",
    "G4": "SSN 321-54-9876, also 321549876.",
    "G5": "Card 4000-1234-5678-9010.",
    "G6": "Card 4000123456789010.",
    "G7": "Host 10.0.0.7 build 999.1.2.3",
    "G8": "See https://wiki.corp.io/a?b=1. Then https://u@corp.io/x",
    "G9": "ann@corp.io wrote; ann@corp.io again",
    "G10": "Mary Baker met Олена Бондар and Zork Quux",
    "G11": "Team Alpha\nMary Stone",
    "G12": "   ",
}
PARITY = {
    "G1": [(9, 24, "email"), (28, 39, "email")],
    "G2": [(5, 17, "phone"), (21, 35, "phone")],
    "G3": [(5, 13, "slack_handle"), (15, 18, "slack_handle")],
    "G4": [(4, 15, "ssn"), (22, 31, "ssn")],
    "G5": [(5, 24, "credit_card")],
    "G6": [(11, 21, "phone")],
    "G7": [(5, 13, "ip_address"), (20, 29, "ip_address")],
    "G8": [(4, 31, "url"), (45, 54, "email")],
    "G9": [(0, 11, "email")],
}
SAFE = {
    **PARITY,
    "G6": [(5, 21, "credit_card")],
    "G8": [(4, 31, "url"), (37, 56, "url")],
    "G9": [(0, 11, "email"), (19, 30, "email")],
}
NAMES = {
    "G10": [(0, 10, 0.7), (15, 27, 0.7), (32, 41, 0.5)],
    "G11": [(0, 10, 0.5), (11, 21, 0.6)],
}


def texts_frame(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, body string")


def spans_by_doc(df, expression):
    rows = df.select("doc_id", F.expr(f"inline({expression})").alias(*SPAN_FIELDS))
    out = {}
    for r in rows.collect():
        out.setdefault(r["doc_id"], []).append(
            (r["start"], r["end"], r["layer"], r["seq"], r["text"], r["pii_type"], r["confidence"])
        )
    return out


@pytest.mark.parametrize("policy,want", [(Policy.reference(), PARITY), (Policy(), SAFE)])
def test_golden_texts(spark, policy, want):
    ids, texts = zip(*GOLDEN.items())
    got = spans_by_doc(texts_frame(spark, texts), found_spans("body", Detector(), policy))
    for i, name in enumerate(ids):
        spans = got.get(i, [])
        assert [(s[0], s[1], s[5]) for s in spans if s[2] == 2] == want.get(name, []), name
        assert [(s[0], s[1], s[6]) for s in spans if s[2] == 5] == NAMES.get(name, []), name


PIECES = (
    "ann@corp.io", "@dev_ops", "a.b-c", "415-555-0134", "(415) 555 0134", "+1", "321-54-9876",
    "4000123456789010", "4000-1234-5678-9010", "10.0.0.7", "1.2.3.4.5", "https://x.io/a?b", "http://",
    "Mary", "Baker", "O'Neil", "Олена", "Бондар", "École", "été", "Straße", "😀", "K@k.com",
    "١٢٣", "²", "_", " ", "\n", " ", "\t", ".", ",", "-", "'", "|", "1", "23", "456", "@", "x@y.zz",
)


def random_texts(n, seed=7):
    rng = random.Random(seed)
    return [
        "".join(
            rng.choice(PIECES) + rng.choice(("", "", " ", ".", "-"))
            for _ in range(rng.randint(1, 14))
        )
        for _ in range(n)
    ]


def test_rule_hits_equal_python(spark):
    texts = random_texts(3000)
    df = texts_frame(spark, texts)
    for rule in R.REGEX_RULES:
        rows = df.select("doc_id", F.expr(rule_hits("body", rule)).alias("hits")).collect()
        for r in rows:
            text = texts[r["doc_id"]]
            want = [(*m.span(), m[0]) for m in re.finditer(rule.pattern, text, re.I)]
            assert [tuple(h) for h in r["hits"]] == want, (rule.name, text)


@pytest.mark.parametrize("order,repeats", [
    ("longest", "all"), ("longest", "first"), ("reference", "first"), ("reference", "all"),
])
def test_arbitration_equals_model(spark, order, repeats):
    texts = random_texts(2000, seed=11)
    got = spans_by_doc(
        texts_frame(spark, texts),
        found_spans("body", Detector(), Policy(order, repeats)),
    )
    for i, text in enumerate(texts):
        matches, uncertain = twin.detect(text, order, repeats)
        assert sorted(got.get(i, [])) == sorted(matches + uncertain), text


def test_documents_equal_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rich = derived(docs, RICH_TEXT).withColumnRenamed("text", "body")
    texts = {r["doc_id"]: r["body"] for r in rich.collect()}
    got = spans_by_doc(rich, found_spans("body", Detector(), Policy.reference()))
    for i, text in texts.items():
        matches, uncertain = twin.detect(text, "reference", "first")
        assert sorted(got.get(i, [])) == sorted(matches + uncertain)


def test_kept_spans_never_overlap(spark):
    texts = random_texts(1500, seed=3)
    for policy in (Policy(), Policy.reference()):
        got = spans_by_doc(texts_frame(spark, texts), found_spans("body", Detector(), policy))
        for spans in got.values():
            for layer in (lambda s: s[2] == 2, lambda s: s[2] == 5):
                kept = [s for s in spans if layer(s)]
                assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))


def test_layers_with_configuration(spark):
    learned = (("person_name", "ann"), ("nickname", "CORP.io"))
    custom = ((r"[0-9]{3}", "custom", 0.9), (r"Mary", "team_name", 0.5))
    detector = Detector().with_learned(learned, ("MARY baker", "10.0.0.7"))
    for pattern, kind, confidence in custom:
        detector = detector.with_custom_pattern(pattern, kind, confidence)
    texts = random_texts(800, seed=5) + ["Ann annual ANN", "MARY BAKER Mary Baker"]
    got = spans_by_doc(texts_frame(spark, texts), detect_spans("body", detector))
    model = [(t if t in R.TYPE_PRIORITY else "custom", v) for t, v in learned]
    for i, text in enumerate(texts):
        want = twin.claims(twin.raw_spans(
            text, custom=custom, learned=model, safe=("mary baker", "10.0.0.7")
        ))
        assert got.get(i, []) == want, text


def test_learned_word_boundary(spark):
    detector = Detector(rules=(), names=False, learned_boundary=True).with_learned(
        pii=[("person_name", "Ann")]
    )
    got = spans_by_doc(texts_frame(spark, ["Ann annual, ANN."]), detect_spans("body", detector))
    assert [(s[0], s[1]) for s in got[0]] == [(0, 3), (12, 15)]


def test_contextual_phrase(spark):
    texts = ["Dear Mary Stone, hi", "project: Falcon Two done. x"]
    df = texts_frame(spark, texts)
    person = spans_by_doc(df, contextual_spans("body", "person_name"))
    assert [(s[4], s[0]) for s in person[0]] == [("Mary Stone", 5)]
    project = spans_by_doc(df, contextual_spans("body", "project_name"))
    assert project[1][0][4] == "Falcon Two done"  # case-blind, so any word goes on


def test_long_keyword_phrase_needs_no_stack(spark):
    text = "from " + "Word " * 60_000
    got = spans_by_doc(texts_frame(spark, [text]), contextual_spans("body", "person_name"))
    assert len(got[0]) == 1 and got[0][0][1] == len(text) - 1


def test_text_that_holds_the_fence(spark):
    text = f"a@b.io {FENCE} c@d.io{FENCE}"
    expression = rule_hits("body", R.RULES_BY_NAME["email"])
    row = texts_frame(spark, [text]).select(F.expr(expression).alias("h")).first()
    assert [tuple(h) for h in row["h"]] == [(0, 6, "a@b.io"), (9, 15, "c@d.io")]


def test_context_snippet(spark):
    text = "x" * 60 + "HIT" + "y" * 10
    df = spark.createDataFrame([(text, 60, 63), ("HIT", 0, 3)], "t string, s int, e int")
    got = [r[0] for r in df.select(F.expr(context_of("t", "s", "e"))).collect()]
    assert got == ["..." + "x" * 50 + "HIT" + "y" * 10, "HIT"]


def test_blank_text_has_no_spans(spark):
    detector = Detector().with_custom_pattern(r" +", "custom")
    got = spans_by_doc(texts_frame(spark, ["   \n\t"]), found_spans("body", detector))
    assert got == {}


def test_empty_matches_equal_python(spark):
    df = texts_frame(spark, ["baac"])
    hits = df.select(F.expr(regex_hits("body", text_literal("a*"))).alias("h")).first()["h"]
    assert [tuple(h) for h in hits] == [(*m.span(), m[0]) for m in re.finditer("a*", "baac")]


def test_detection_is_narrow_and_scans_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = unit_spans(whole_units(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_guards_miss_no_hit(spark):
    """A guard is a necessary condition of its pattern, in every case of a letter."""
    points = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343")
    letters = points.select(F.udf(chr, "string")("id").alias("c")).cache()
    first = sorted({word[0] for words in R.CONTEXT_KEYWORDS.values() for word in words})
    for char in first:
        cases = letters.where(F.col("c").rlike(f"(?iuU)^{char}$"))
        assert not cases.where(~F.col("c").rlike(f"^{R.any_case(char)}$")).count()
    heads = ["", "a", "1", "_", "é", "я", " ", "-", "\U00010400", "́"]
    words = [w for words in R.CONTEXT_KEYWORDS.values() for w in words]
    texts = [f"{h}{w}: Anna ſmith" for w in (*words, *map(str.upper, words), "Kolega", "sinKerely") for h in heads]
    texts += [f"{h}{p}" for h in (*heads, "+", "+1 ", "1-", "(") for p in ("(415) 555-0199", "@user x", "@a.b", "٤١٥ 555 0199")]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    pairs = [(R.java_regex(R.contextual_pattern(k), True), R.java_regex(R.contextual_pattern(k), True, R.contextual_guard(k))) for k in R.CONTEXT_KEYWORDS]
    pairs += [(R.java_regex(r.pattern, True), r.regex) for r in R.REGEX_RULES if r.name in ("phone", "slack_handle")]
    for plain, guarded in pairs:
        hits = [F.regexp_extract_all("body", F.lit(p), F.lit(0)) for p in (plain, guarded)]
        assert not df.where(hits[0] != hits[1]).count()
        assert df.where(F.size(hits[0]) > 0).count()


def test_a_large_table_is_dealt_out_by_its_bytes(spark, tmp_path, monkeypatch):
    from cloakspan.functions import dealing

    path = str(tmp_path / "one-group")
    spark.range(20_000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(path)
    monkeypatch.setattr(dealing, "TASK_BYTES", 50_000)
    table = spark.read.parquet(path)
    dealt = dealing.deal_out(table, "id")
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(table).isEmpty() and dealt.count() == 20_000
