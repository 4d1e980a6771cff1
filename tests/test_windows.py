"""Patterns searched in a text's windows find what they find in the whole text."""

import random

from pyspark.sql import functions as F

from cloakspan.functions.expr import compute_once, text_literal
from cloakspan.functions.placeholders import placeholder_regex, render_placeholder, taken_numbers
from cloakspan.functions.spans import regex_hits
from cloakspan.functions.windows import windows
from cloakspan.operators.detect import Detector, raw_spans
from cloakspan.operators.occurrences import occurrences
from cloakspan.operators.restore import placeholder_hits
from cloakspan.rules import PLACEHOLDER_LISTS, PLACEHOLDER_TEMPLATES

SPACES = [" ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", ""]
PIECES = [
    "mary", "Mary", "Baker", "McCoy", "O'Neil", "Іван", "Бойко", "слово", "A", "a.b", "4", "٣٤٥",
    "mary.b@corp.io", "йa.b@corp.io.d@e.com", "K@ſ.io", "@dev_1", "x@dev", "@user1", "+1", "(415)",
    "415", "555-0134", "1-415-555-0134", "100-12-3456", "100 12 3456", "4000 1234 5678 0001",
    "10.0.0.7", "10.0.0.7.", "https://a.io/x?y", "HTTPS://b", "http:", "://", "\U0001d400", "é",
    "́b", "﷐", "𝒜b@c.io", "_", ".", "-", "John Doe", "Acme Inc", "555-000-0001",
    "Project Alpha 3", "12 Example Street, Anytown, ST 12345", "[REDACTED-4]", "1990-01-07", "\x01",
]


def random_texts(spark, many=1500):
    draw = random.Random(7)
    texts = ["", "   ", None, "a plain text. Of words, and more words."]
    for _ in range(many):
        parts = []
        for _ in range(draw.randrange(1, 14)):
            parts += [draw.choice(PIECES), draw.choice(SPACES)]
        texts.append(draw.choice(["", " "]) + "".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    return compute_once(df.repartition(4), _windows=windows("body"))


def test_windows_find_the_spans_of_the_whole_text(spark):
    whole, inside = raw_spans("body", Detector()), raw_spans("body", Detector(), None, "_windows")
    got = random_texts(spark).select("body", F.array_sort(F.expr(whole)), F.array_sort(F.expr(inside)))
    rows = got.collect()
    assert sum(len(r[1]) for r in rows) > 3000
    assert [(r[0], r[1], r[2]) for r in rows if r[1] != r[2]] == []


def test_windows_find_the_placeholders_of_the_whole_text(spark):
    whole = regex_hits("body", text_literal(placeholder_regex()))
    got = random_texts(spark).select("body", F.expr(whole), F.expr(placeholder_hits("_windows")))
    rows = got.collect()
    assert sum(len(r[1]) for r in rows) > 1000
    assert [(r[0], r[1], r[2]) for r in rows if r[1] != r[2]] == []


def test_each_placeholder_lies_in_a_window(spark):
    kinds = [(k, n) for k in PLACEHOLDER_TEMPLATES for n in (1, 2, 40, 12345)]
    kinds += [(k, n + 1) for k, words in PLACEHOLDER_LISTS.items() for n in range(len(words))]
    df = spark.createDataFrame(kinds, "kind string, n long")
    made = df.withColumn("body", F.expr(f"concat('say ', {render_placeholder('kind', 'n')}, ' or')"))
    taken = made.select("kind", "n", F.expr(taken_numbers("body")).alias("t")).collect()
    assert all((r.kind, r.n) in {(t.kind, t.n) for t in r.t} for r in taken)


def test_plain_text_has_no_windows(spark):
    texts = [("Some plain words. A few more, Then none",), ("see a1 and Mary  Baker or",), (None,)]
    df = spark.createDataFrame(texts, "body string").coalesce(1)
    got = [[tuple(w) for w in r[0]] for r in df.select(F.expr(windows("body"))).collect()]
    assert got == [[], [(4, "a1"), (11, "Mary  Baker")], []]


def test_texts_are_cut_into_grams_once(spark):
    units = spark.createDataFrame(
        [(1, 1, 0, "an <email> and <email>1, <ssn> x<email"), (2, 2, 0, "<email>")],
        "scope_id long, doc_id long, unit_no int, text string",
    )
    values = spark.createDataFrame([(1, "<email>"), (1, "<ssn>"), (2, "<ssn>")], "scope_id long, value string")
    found = occurrences(units, values, [], on=["scope_id"], case_blind=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") == 1
    rows = sorted((r.doc_id, r.start, r.text) for r in found.collect())
    assert rows == [(1, 3, "<email>"), (1, 15, "<email>"), (1, 25, "<ssn>")]
