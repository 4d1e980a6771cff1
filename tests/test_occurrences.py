"""Values in texts next to the same values as regexes."""

import random

import pytest

from cloakspan.functions.spans import regex_hits
from cloakspan.operators.detect import literal_regex
from cloakspan.operators.occurrences import fold_in_place, occurrences
from cloakspan.sources.units import whole_units

LETTERS = ["a", "A", "b", "ß", "ẞ", "s", "SS", "K", "k", "K", "İ", "i", "ı", "ŉ", "ﬁ", "fi", "σ", "ς", "Σ", "ᾳ", "ᾼ"]
LETTERS += [" ", "-", ".", "1", "\U0001f600", "\U00010400", "\U00010428", "\n", "é", "É", "$"]


def frames(spark, texts, values):
    units = whole_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    return units, spark.createDataFrame([(v, f"k{i}") for i, v in enumerate(values)], "value string, kind string")


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "start", "text", "value", "kind").collect())


def by_regex(spark, units, values, boundary=False, case_blind=True):
    """Every value searched in every text."""
    out = []
    for i, v in enumerate(values):
        if not v:
            continue
        regex = literal_regex(v, boundary)
        if not case_blind:
            regex = regex.replace("(?iuU)", "(?U)")
        pattern = "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = units.selectExpr("doc_id", f"inline({regex_hits('text', pattern)})").collect()
        out += [(r["doc_id"], r["start"], r["text"], v, f"k{i}") for r in rows]
    return sorted(out)


@pytest.mark.parametrize("boundary,case_blind", [(False, True), (True, True), (False, False)])
def test_equals_a_search_for_each_value(spark, boundary, case_blind):
    rng = random.Random(31)
    # Java's look-behind sees only half of a letter beyond the basic plane
    letters = [x for x in LETTERS if x < "\uffff"] if boundary else LETTERS
    take = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [None, "", " ", *(take(rng.randrange(1, 300)) for _ in range(40))]
    values = ["", "aa", "aAa", "a", "ß", "ss", "\U00010400", *(take(rng.randrange(1, 4)) for _ in range(15))]
    values += [t[5:12] for t in texts[3:15]] + [texts[-1].swapcase(), texts[-1][:90]]
    units, table = frames(spark, texts, values)
    got = found(occurrences(units, table, ["kind"], case_blind=case_blind, boundary=boundary, chunk=40, width=8))
    assert got == by_regex(spark, units, values, boundary, case_blind)


def test_fold_keeps_places(spark):
    text = "".join(map(chr, [*range(1, 0xD800), *range(0xE900, 0x10000), *range(0x10400, 0x10450)]))
    df = spark.createDataFrame([(text,)], "text string")
    row = df.selectExpr("length(text) AS n", f"length({fold_in_place('text')}) AS m").first()
    assert row["n"] == row["m"] == len(text)


def test_many_values_in_a_long_text(spark):
    """A megabyte with 10,000 values; a repeated letter is one value's run."""
    values = [f"value-{i:05d}" for i in range(10_000)] + ["zz"]
    text = " and ".join(v.upper() for v in values) + " " * 700_000 + "z" * 9_001
    units, table = frames(spark, [text, "value-00001 zzz"], values)
    rows = found(occurrences(units, table, ["kind"]))
    assert len(rows) == 10_001 + 4_500 + 2
    assert all(r[2].lower() == r[3] and r[2] == (text if r[0] == 0 else "value-00001 zzz")[r[1]: r[1] + len(r[2])] for r in rows)


def test_texts_do_not_shuffle(spark):
    units, table = frames(spark, ["some text"], ["text"])
    plan = occurrences(units, table, ["kind"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "Python" not in plan
    assert occurrences(units, table.limit(0), ["kind"]).count() == 0
    assert occurrences(units.limit(0), table, ["kind"]).count() == 0
