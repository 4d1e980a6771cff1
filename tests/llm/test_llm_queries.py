"""The registered queries and the pipeline."""

import base64
import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from checks.compare import TABLES, rows_of
from cloakspan.llm import quality
from cloakspan.llm.queries import ORACLES, QUERIES

from .test_llm_duplicates import brute_components, counted, plain_fingerprint, words_of
from .test_llm_text_filters import base_spans


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert list(map(repr, got)) == list(map(repr, rows_of(columns, cursor.fetchall())))


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Every stage next to plain Python; the trained score is taken as given."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality.score(documents, quality.train(documents, labels))
    good = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["doc_id"] in good}

    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = brute_components(sorted(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    texts = {i: t for i, t in texts.items() if root[i] == i}

    items = [words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    shingles = [counted(item) for item in items]

    def holds(words):
        held = counted(words)
        for item, wanted in zip(items, shingles):
            if not held & wanted:
                continue
            for at in range(max(1, len(words) - len(item) + 1)):
                window = counted(words[at : at + len(item)])
                shared = (window & wanted).total()
                if shared >= 0.8 * (window.total() + wanted.total() - shared):
                    return True
        return False

    texts = {i: t for i, t in texts.items() if not holds(words_of(t))}
    for i, text in texts.items():
        for start, _, end in _merged(base_spans(text)):
            text = text[:start] + "[SECRET]" + text[end:]
        texts[i] = text

    with open(public_tokenizers.path(corpus_pipeline.TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i]["ids"] == encoding.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["n_chars"] == len(text)


def _merged(spans):
    """Overlapping spans as one, from the last to the first."""
    joined = []
    for start, kind, end in spans:
        if joined and start < joined[-1][2]:
            joined[-1] = (joined[-1][0], kind, max(end, joined[-1][2]))
        else:
            joined.append((start, kind, end))
    return reversed(joined)


def test_stages_on_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, ids int"
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, "no id at all"), (5, "word " * 40_000)]
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", 1) for i, t in rows], schema)
    for table in (docs, docs.limit(0)):
        for name, apply in corpus_pipeline.STAGES:
            made = apply(spark, table, sf_dir)
            if name != "byte-level bpe":
                assert made.columns == docs.columns
            if name in ("benchmark decontamination", "secret scans", "byte-level bpe"):
                assert made.count() == table.count()
            else:
                assert made.count() <= table.count()


def test_stages_decide_by_row(spark, tmp_path):
    """Ids that repeat with other texts, and rows without an id."""
    passage = " ".join(f"item{i}" for i in range(40))
    rng = random.Random(2)
    other = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    own, copied, lone, hidden = other(), other(), other(), other()
    rows = [
        (1, own), (2, copied), (2, own), (3, copied), (None, lone), (None, lone.upper()), (None, copied),
        (4, f"{hidden} {passage}"), (4, hidden), (None, passage), (5, None), (6, ""), (7, own), (7, own),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, last string")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = texts(kept)
    one_of_two = [k for k in got if k[0] is None and k[1].lower() == lone]
    assert len(one_of_two) == 1
    del got[one_of_two[0]]
    want = [(1, own), (2, copied), (4, f"{hidden} {passage}"), (4, hidden), (None, passage), (5, None)]
    assert got == Counter(want)
    clean = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert texts(clean) == Counter(r for r in rows if passage not in (r[1] or ""))
