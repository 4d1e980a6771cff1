"""Pattern tables: literals, and spans next to the same patterns as rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakspan.operators import patterns as patterns_module
from cloakspan.operators.detect import Detector, fold_case, raw_spans
from cloakspan.operators.learning import pattern_rules
from cloakspan.operators.numbering import number_rows
from cloakspan.operators.occurrences import file_by_texts
from cloakspan.operators.patterns import pattern_spans, required_literals
from cloakspan.operators.redact import Layers, redact_units
from cloakspan.sources.units import whole_units

PATTERNS = "name string, pattern string, pii_type string, confidence double, at int"


@pytest.mark.parametrize(
    "pattern,literals",
    [
        ("abc", ["abc"]),
        (r"\bPRJ-[0-9]{3}\b", ["PRJ-"]),
        (r"x?longer\d+tail", ["longer"]),
        ("(?:red|green)[0-9]", ["green", "red"]),
        ("(?:red|[0-9])x", ["x"]),
        ("(?:red|[0-9]*)", []),
        (r"\d{4}", []),
        ("(ab)+c", ["ab"]),
        ("(ab)*cd", ["cd"]),
        ("a(?=zzzz)b", ["ab"]),
        ("(?i)Host", ["Host"]),
        (r"corp\.io", ["corp.io"]),
        (r"\p{L}+x", []),
        ("(?<n>x)", []),
        ("", []),
    ],
)
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_each_hit_holds_a_required_literal():
    rng = random.Random(3)
    parts = ["ab", "c", "(?:de|fg)", "h?", "[xy]", "(?:ab)+", "c*", "(k(l|m))", r"\d", "."]
    text = "".join(rng.choice("abcdefghklmxy12") for _ in range(20_000))
    for _ in range(300):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        literals = required_literals(pattern)
        for hit in re.finditer(pattern, text):
            assert not literals or any(x in hit.group() for x in literals)


def texts(spark):
    rng = random.Random(8)
    words = ["Anna", "anna", "PRJ-001", "prj-002", "corp.io", "ß", "STRASSE", "Straße", "12-34", "x1", "K", "K", "İ"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "PRJ-001 " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def pattern_table(spark):
    rows = [
        ("p1", r"PRJ-\d{3}", "project_name", 0.9, 1), ("p2", "(?i)prj-00[12]", "mood", 0.4, 0),
        ("p3", r"\d\d-\d\d", "custom", None, 2), ("p4", "(?i)straße", "custom", 0.75, 2),
        ("p5", "corp\\.(?:io|com)", "company_name", 0.8, 5), ("p6", r"\s", "custom", 0.9, 6),
        ("p7", "(?i)k", "custom", 0.9, 7), ("p8", "Anna|Otto", "person_name", 0.9, 8),
        ("p9", r"\p{Lu}1?", "custom", 0.9, 9), ("p10", None, "custom", 0.9, 9),
    ]
    return spark.createDataFrame(rows, PATTERNS).select(
        "name", "pattern", "pii_type", "confidence", F.timestamp_seconds("at").alias("created_at")
    )


def spans_of(df):
    columns = ["doc_id", "start", "end", "text", "pii_type", "confidence", "layer", "seq", "priority", "rule", "status"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 256])
def test_table_finds_what_the_rules_find(spark, block):
    patterns = pattern_table(spark)
    units = whole_units(texts(spark))
    got = spans_of(pattern_spans(units, patterns, block=block))
    detector = Detector(rules=(), names=False, custom_patterns=pattern_rules(patterns.where("pattern IS NOT NULL")))
    inside = F.expr(f"inline({raw_spans('body', detector)})")
    blank = units.withColumnRenamed("text", "body").where(r"body RLIKE '\\S'")
    assert got == spans_of(blank.select("doc_id", inside)) and got


def test_plan_does_not_grow_with_the_patterns(spark):
    units = whole_units(texts(spark))

    def plan(many):
        rows = [(f"n{i}", f"value{i}x", "custom", 0.9, i) for i in range(many)]
        patterns = spark.createDataFrame(rows, PATTERNS).withColumn("created_at", F.timestamp_seconds("at"))
        return len(pattern_spans(units, patterns)._jdf.queryExecution().optimizedPlan().toString())

    small, large = plan(10), plan(400)
    assert large < 4 * small  # a bitmap of the grams is all that grows, up to its bound


def test_patterns_take_part_in_a_redaction(spark):
    units = whole_units(texts(spark))
    empty = pattern_table(spark).limit(0)
    none = redact_units(units, layers=Layers(patterns=empty)).texts
    assert {r["redacted"] for r in none.collect()} >= {None, ""}
    run = redact_units(units, layers=Layers(patterns=pattern_table(spark)))
    assert not run.texts.where("redacted LIKE '%PRJ-%'").count()


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    got = number_rows(rows, ["v"]).collect()
    assert sorted((r["v"], r["n"]) for r in got) == [(i, i + 1) for i in range(1000)]
    assert number_rows(rows.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("few", [0, 100])
def test_filed_and_tried_patterns_find_the_same(spark, few):
    """Patterns of a small table are tried in the row, others by a join."""
    patterns = pattern_table(spark)
    twice = patterns.union(patterns.withColumn("name", F.concat("name", F.lit("b"))))
    units = whole_units(texts(spark))
    got = spans_of(pattern_spans(units, twice, few=few))
    detector = Detector(rules=(), names=False, custom_patterns=pattern_rules(twice.where("pattern IS NOT NULL")))
    inside = F.expr(f"inline({raw_spans('body', detector)})")
    blank = units.withColumnRenamed("text", "body").where(r"body RLIKE '\\S'")
    assert got == spans_of(blank.select("doc_id", inside)) and got


def test_a_text_meets_few_of_many_patterns_alike(spark):
    """Numbered patterns share their grams; a text meets those filed under grams
    that other texts lack, and none if its characters stand nowhere in a gram."""
    rows = [(i, f"of letters only {'and more ' * i}") for i in range(20)]
    rows += [(100 + i, f"paid by #{i:09d} and #{i * 37:09d}") for i in range(40)]
    units = whole_units(spark.createDataFrame(rows, "doc_id long, text string"))
    literals = spark.range(20_000).selectExpr("concat('#', lpad(cast(id AS string), 9, '0')) AS folded")
    filed = file_by_texts(literals.withColumn("regex", F.col("folded")), units, fold_case)
    met = patterns_module._candidates(units, filed.select("gram", "folded", "regex"))
    sizes = {r["doc_id"]: r["n"] for r in met.select("doc_id", F.size("entries").alias("n")).collect()}
    assert set(sizes) == set(range(100, 140)) and max(sizes.values()) <= 8
    shown = patterns_module._like_grams("text", filed)
    cut = units.select(F.expr(f"size({shown})").alias("n"), "doc_id").collect()
    assert all((r["n"] > 0) == (r["doc_id"] >= 100) for r in cut)


def test_equal_patterns_are_analysed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    analysed = patterns_module._analysed

    def counted(tables):
        for table in tables:
            seen.add(len(table))
            yield from analysed([table])

    monkeypatch.setattr(patterns_module, "_analysed", counted)
    rows = [(f"n{i}", f"value{i % 10}x", "custom", 0.9, i) for i in range(300)]
    patterns = spark.createDataFrame(rows, PATTERNS).withColumn("created_at", F.timestamp_seconds("at"))
    known = patterns_module.prepared_patterns(patterns)
    assert known.count() == 300 and known.select("regex").distinct().count() == 10
    assert seen.value == 10


@pytest.mark.parametrize("most", [0, 512])
def test_grams_of_any_characters_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(patterns_module, "MOST_CHARS", most)
    parts = ["a", "?", "]", "-", "^", " ", "\\", "é", "ж", "字", "😀", "😁", "ß", "\ufffd", "9"]
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(parts) for _ in range(400))) for i in range(30)]
    cut = [text[k : k + size] for _, text in rows for size in (1, 3, 5, 8) for k in (17, 230)]
    table = [(f"n{i}", re.escape(x), "custom", 0.9, i) for i, x in enumerate(cut)]
    patterns = spark.createDataFrame(table, PATTERNS).withColumn("created_at", F.timestamp_seconds("at"))
    units = whole_units(spark.createDataFrame(rows, "doc_id long, text string"))
    some = pattern_spans(units, patterns).select("doc_id", "start", "text", "rule").collect()
    found = [(i, m.start(), x, f"n{n}") for i, text in rows for n, x in enumerate(cut)
             for m in re.finditer(re.escape(x), text)]
    assert sorted(map(tuple, some)) == sorted(found)
