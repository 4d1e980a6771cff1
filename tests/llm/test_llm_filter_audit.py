"""The filter audit next to plain Python."""

import re
from collections import Counter
from itertools import permutations

import pytest

from cloakspan.llm import filter_audit

DOCS = "doc_id long, text string, lang string, kept int, mask int"
LABELS = "doc_id long, quality int, toxic int, n int"


def plain_audit(docs, labels):
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and i > least[text],
        }
        failed = frozenset(k for k, v in fails.items() if v)
        parts.setdefault(lang or "", []).append((failed, i in good, i in toxic))
    out = set()
    for part, rows in parts.items():
        shares, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, letter in enumerate(order, 1):
                hit = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                fails = sum(letter in r[0] for r in rows)
                shares[letter] += len(hit)
                found.append((
                    part, order, step, len(left), len(hit), fails - len(hit),
                    sum(r[0] == {letter} for r in rows), sum(r[1] for r in hit), sum(r[2] for r in hit),
                ))
        out |= {(*row, shares[row[1][row[2] - 1]]) for row in found}
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (4, None, "fr"),
        (5, "", "fr"), (None, "", "fr"), (None, None, ""), (6, "AAA bb # cc", "en"),
        (7, "aa\x0baa\x1caa aa aa aa aa aa", "de"), (8, "Ünï ÄÖ \U0001f600", "de"), (-3, long + " |", "de"),
        (9, "a " * 300, "en"), (10, "a " * 300, "fr"), (6, "same id, other text", "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (None, 1, 1), (6, 0, 1), (99, 1, 1)]
    got = filter_audit.audit_texts(
        spark.createDataFrame([(*d, 7, 7) for d in docs], DOCS),
        spark.createDataFrame([(*x, 7) for x in labels], LABELS),
    )
    assert rows_of(got) == sorted(plain_audit(docs, labels))


def test_audit_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    expected = plain_audit(
        [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()],
        [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()],
    )
    assert rows_of(filter_audit.audit_texts(docs, labels)) == sorted(expected)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit_texts(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en", 0, 0)], DOCS)
    assert filter_audit.audit_texts(one, labels).count() == 600


def test_a_prefix_is_evaluated_once(spark):
    masks = spark.createDataFrame([(m,) for m in range(32)], "mask int")
    assert filter_audit.steps(masks).count() == 325 * 32
    with pytest.raises(ValueError):
        filter_audit.steps(masks, "ABCDEFG")
