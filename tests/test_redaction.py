"""Redaction, mapping and restoration against the Python model."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

import twin
from checks.inputs import RICH_TEXT, derived, documents
from cloakspan.functions.expr import text_literal
from cloakspan.functions.placeholders import placeholder_regex, render_placeholder
from cloakspan.operators import crypto
from cloakspan.operators.crypto import Keyring
from cloakspan.operators.detect import Detector
from cloakspan.operators.mapping import (
    assign_placeholders,
    extend_mapping,
    load_mapping,
    save_mapping,
    seal,
    unseal,
)
from cloakspan.operators.numbering import block_borders, block_of, number_in_scope
from cloakspan.operators.redact import (
    ACCEPT_ALL,
    SKIP_UNCERTAIN,
    Policy,
    decide,
    redact_rows,
    redact_units,
    row_mapping,
    unit_spans,
)
from cloakspan.operators.restore import (
    restore_strict,
    restore_units,
    restore_units_sequential,
)
from cloakspan.rules import PII_TYPES
from cloakspan.sources.units import split_units, whole_units
from test_detection import random_texts

PLAIN = ["scope_id", "pii_type", "value_lc", "original", "n", "placeholder"]


@pytest.fixture(scope="module")
def rich(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return derived(docs, RICH_TEXT).cache()


def as_units(run):
    return run.texts.drop("text").withColumnRenamed("redacted", "text")


@pytest.mark.parametrize("accept_all", [False, True])
@pytest.mark.parametrize("policy,model", [
    (Policy(), twin.redact_safe), (Policy.reference(), twin.redact_reference),
])
def test_rows_equal_model(rich, policy, model, accept_all):
    mode = ACCEPT_ALL if accept_all else SKIP_UNCERTAIN
    redacted = redact_rows(rich, policy=policy, mode=mode)
    mapping = {}
    for r in row_mapping(redacted, ["doc_id"]).collect():
        key = (r["pii_type"], r["value_lc"])
        mapping.setdefault(r["doc_id"], {})[key] = (r["placeholder"], r["original"])
    for r in redacted.collect():
        text, total, uncertain, made = model(r["text"], accept_all)
        assert (r["redacted"], r["total"], r["uncertain"]) == (text, total, uncertain)
        assert {k: v[0] for k, v in mapping.get(r["doc_id"], {}).items()} == made.by_key
        assert sum(r["by_type"].values()) == total


def test_overlapping_reference_splice(spark):
    """Uncertain spans over matches cut into each other in the old splice."""
    texts = random_texts(1500, seed=23)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = redact_rows(df, policy=Policy.reference(), mode=ACCEPT_ALL).collect()
    for r in got:
        assert r["redacted"] == twin.redact_reference(r["text"], True)[0]


def test_units_equal_rows(rich):
    by_row = redact_rows(rich, mode=ACCEPT_ALL).select("doc_id", "redacted")
    run = redact_units(whole_units(rich), mode=ACCEPT_ALL)
    assert by_row.exceptAll(run.texts.select("doc_id", "redacted")).count() == 0


def test_gate_keeps_every_text_with_a_span(spark):
    """Custom, learned and name layers: no text with an edit takes the short way."""
    detector = Detector().with_learned(pii=[("person_name", "ann")]).with_custom_pattern("z+")
    texts = random_texts(600, seed=9) + ["ANN", "zz", "", "Zork Quux", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for mode in (SKIP_UNCERTAIN, ACCEPT_ALL):
        want = redact_rows(df, detector, mode=mode).select("doc_id", "redacted")
        got = redact_units(whole_units(df), detector, mode=mode).texts
        assert want.exceptAll(got.select("doc_id", "redacted")).count() == 0
        assert got.count() == len(texts)


def test_corpus_scope_equals_model(rich):
    run = redact_units(whole_units(rich, scope=F.lit("corpus")), mode=ACCEPT_ALL)
    got = {r["doc_id"]: r["redacted"] for r in run.texts.collect()}
    mapping = twin.Mapping()
    for r in rich.orderBy("doc_id").collect():
        text, _, _, mapping = twin.redact_safe(r["text"], True, mapping)
        assert got[r["doc_id"]] == text
    rows = {(r["pii_type"], r["value_lc"]): r["placeholder"] for r in run.mapping.collect()}
    assert rows == mapping.by_key


def test_result_does_not_depend_on_partitions(rich):
    runs = []
    for n in (1, 7):
        units = whole_units(rich.repartition(n), scope=F.lit("corpus"))
        runs.append(redact_units(units, mode=ACCEPT_ALL).texts.select("doc_id", "redacted"))
    assert runs[0].exceptAll(runs[1]).count() == 0


def test_round_trip_gives_the_source(rich):
    """Values of one casing come back exactly."""
    for units in (whole_units(rich), split_units(rich), whole_units(rich, scope=F.lit("c"))):
        run = redact_units(units, mode=ACCEPT_ALL)
        restored = restore_units(as_units(run), run.mapping).select(
            "doc_id", "unit_no", "restored"
        )
        source = units.select("doc_id", "unit_no", "text")
        assert source.exceptAll(restored).count() == 0


def test_no_kept_original_survives(rich):
    run = redact_units(whole_units(rich), mode=ACCEPT_ALL)
    left = run.texts.join(run.mapping, "scope_id").where(
        F.expr("contains(lower(redacted), value_lc) AND length(value_lc) > 6")
    )
    # a street of other digits may hold a short value; long ones must be gone
    assert left.where("pii_type IN ('email', 'ssn', 'credit_card', 'url')").count() == 0


def test_incremental_mapping_covers_the_same_values(rich):
    spans = decide(unit_spans(whole_units(rich, scope=F.lit("c"))), SKIP_UNCERTAIN).cache()
    once = assign_placeholders(spans)
    first = assign_placeholders(spans.where("doc_id < 90"))
    added = extend_mapping(first, spans.where("doc_id >= 60"))
    both = first.select(*PLAIN).union(added.select(*PLAIN))
    key = ["pii_type", "value_lc"]
    assert both.select(*key).exceptAll(once.select(*key)).count() == 0
    assert once.select(*key).exceptAll(both.select(*key)).count() == 0
    assert both.groupBy("placeholder").count().where("count > 1").count() == 0


@pytest.mark.parametrize("per_block,unit_block", [(40, 2), (1, 1), (1500, 64), (50_000, 1024)])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_numbers_equal_a_plain_window(spark, per_block, unit_block, ids):
    """One scope, one type and one document hold most of the rows."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("scope_id"),
        F.when(F.col("id") % 2 == 0, "email").otherwise("url").alias("pii_type"),
        F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 91 - 40).cast(ids).alias("doc_ord"),
        (F.col("id") * 7919 % 13).cast("int").alias("unit_no"),
        F.col("id").cast("int").alias("pos"),
    )
    got = number_in_scope(
        rows, ["scope_id", "pii_type"], rows_per_block=per_block, unit_block=unit_block
    )
    plain = Window.partitionBy("scope_id", "pii_type").orderBy("doc_ord", "unit_no", "pos")
    want = rows.withColumn("n", F.row_number().over(plain).cast("long"))
    assert want.exceptAll(got.select(*want.columns)).count() == 0
    assert got.count() == 4000


def test_blocks_are_even_for_ids_of_any_spread(spark):
    """Hashed ids and ids with a long tail fall in blocks of about one size."""
    for doc in (F.xxhash64("id"), F.pow(F.col("id"), 4).cast("long"), F.md5(F.col("id").cast("string"))):
        rows = spark.range(20_000).select(doc.alias("d"), F.lit(0).alias("u"), F.col("id").alias("p"))
        borders = block_borders(rows, ["d", "u", "p"], 1_000)
        sizes = rows.groupBy(block_of(F.col("d"), borders)).count().select("count").collect()
        assert len(sizes) == 20 and max(r[0] for r in sizes) < 2_500


def test_numbers_of_one_document_scopes(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 3).alias("scope_id"), F.lit("url").alias("pii_type"),
        (F.col("id") % 3).alias("doc_ord"),
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).cast("int").alias("unit_no"),
        F.col("id").cast("int").alias("pos"),
    )
    got = number_in_scope(rows, ["scope_id", "pii_type"], document_scopes=True, unit_block=16)
    plain = Window.partitionBy("scope_id").orderBy("unit_no", "pos")
    want = rows.withColumn("n", F.row_number().over(plain).cast("long"))
    assert want.exceptAll(got.select(*want.columns)).count() == 0


def test_placeholders_render_and_are_found(spark):
    numbers = [1, 2, 15, 16, 20, 21, 31, 255, 9999, 10000, 123456]
    rows = [(t, n) for t in PII_TYPES for n in numbers]
    df = spark.createDataFrame(rows, "t string, n long").withColumn(
        "p", F.expr(render_placeholder("t", "n"))
    )
    regex = text_literal("^(?:" + placeholder_regex() + ")$")
    for r in df.withColumn("found", F.expr(f"p RLIKE {regex}")).collect():
        assert r["p"] == twin.placeholder(r["t"], r["n"])
        assert r["found"], r["p"]


def unit_rows(spark, *texts):
    return spark.createDataFrame(
        [("s", i, 0, t) for i, t in enumerate(texts)],
        "scope_id string, doc_id long, unit_no int, text string",
    )


def handle_mapping(spark):
    rows = [("s", "slack_handle", "@ann", "@ann", 1, "@user1", 0, 0, 0),
            ("s", "slack_handle", "@bob", "@bob", 10, "@user10", 0, 0, 1)]
    return spark.createDataFrame(rows, ", ".join([
        "scope_id string", "pii_type string", "value_lc string", "original string",
        "n long", "placeholder string", "doc_ord long", "unit_no int", "pos int"]))


def test_longer_placeholder_wins(spark):
    units = unit_rows(spark, "@user1 @user10", "@user7 stays")
    mapping = handle_mapping(spark)
    safe = {r["doc_id"]: (r["restored"], r["restorations"]) for r in restore_units(units, mapping).collect()}
    assert safe == {0: ("@ann @bob", 2), 1: ("@user7 stays", 0)}
    old = {r["doc_id"]: r["restored"] for r in restore_units_sequential(units, mapping).collect()}
    assert old == {0: "@ann @ann0", 1: "@ann7 stays".replace("@ann7", "@user7")}


def test_sequential_restore_equals_model(rich):
    run = redact_units(whole_units(rich), policy=Policy.reference(), mode=ACCEPT_ALL)
    got = restore_units_sequential(as_units(run), run.mapping).collect()
    sources = {r["doc_id"]: r["text"] for r in rich.collect()}
    for r in got:
        text, _, _, mapping = twin.redact_reference(sources[r["doc_id"]], True)
        want = twin.restore_sequential(text, mapping.restorations)
        assert (r["restored"], r["restorations"]) == want


def test_custom_placeholders_are_restored(spark):
    mapping = handle_mapping(spark).withColumn(
        "placeholder", F.when(F.col("n") == 1, "<A>").otherwise("éx+")
    )
    units = unit_rows(spark, "see <A>, éx+.", "nothing", "<A", "éx+<A>éx+")
    got = restore_units(units, mapping).orderBy("doc_id").collect()
    assert [(r["restored"], r["restorations"]) for r in got] == [
        ("see @ann, @bob.", 2), ("nothing", 0), ("<A", 0), ("@bob@ann@bob", 3),
    ]


def test_the_longest_custom_placeholder_is_restored(spark):
    mapping = handle_mapping(spark).withColumn(
        "placeholder", F.when(F.col("n") == 1, "@user7").otherwise("to @user7x")
    )
    units = unit_rows(spark, "hand to @user7x or @user7")
    got = restore_units(units, mapping).first()
    assert (got["restored"], got["restorations"]) == ("hand @bob or @ann", 2)


def test_staged_tables_of_a_finished_job_are_deleted(spark):
    from cloakspan.functions.staging import scratch, shared_folder, stage

    def staged():
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return len(system.listStatus(path))

    kept = stage(spark.range(3), "kept")
    before = staged()
    with scratch(spark):
        assert stage(spark.range(5), "gone").count() == 5
    assert staged() == before and kept.count() == 3


def test_hot_keys_are_split(spark):
    from cloakspan.functions.joins import join_unique

    rows = spark.range(9_000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS i", "id % 2 AS j")
    rows = rows.withColumn("k", F.when(F.col("i") % 7 == 0, F.lit(None)).otherwise(F.col("k")))
    unique = spark.range(5_000).selectExpr("id AS k", "id * 2 AS v")
    want = rows.join(unique, "k")
    got = join_unique(rows, unique, ["k"], ["i"], rows_per_part=300)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan
    assert "_part" not in join_unique(rows, unique, ["k"], ["i"])._jdf.queryExecution().optimizedPlan().toString()


def test_units_are_read_once(spark, rich, tmp_path):
    """The plans of the results hold the staged copy, not the source."""
    rich.select("doc_id", "text").write.parquet(f"{tmp_path}/source")
    units = whole_units(spark.read.parquet(f"{tmp_path}/source"))
    run = redact_units(units, document_scopes=True)
    restored = restore_units(
        run.texts.drop("text").withColumnRenamed("redacted", "text"), run.mapping
    )
    for df in (run.texts, run.edits, restored):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert df.inputFiles() and not any("/source/" in f for f in df.inputFiles()), plan


def test_taken_numbers_are_moved_around(spark):
    texts = ["a@b.io c@d.io e@f.io person2@example.comx user1 555-000-0001"]
    df = spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string")
    row = redact_rows(df).first()
    assert [s["placeholder"] for s in row["spans"]][:3] == [
        "person1@example.com", "person3@example.com", "person4@example.com",
    ]


def test_many_taken_numbers_stay_rows(spark):
    """Next to plain counting, in small blocks; no row gathers taken numbers."""
    import random

    from cloakspan.operators import mapping

    rng = random.Random(12)
    kinds = {"a": (300, 0), "b": (200, 50), "c": (40, 0), "d": (0, 0)}
    values, taken, want = [], [], {}
    for kind, (many, last) in kinds.items():
        used = {rng.randrange(1, 500) for _ in range(250)} | {10**12} if kind != "c" else set()
        taken += [("s", kind, n) for n in used] * 2
        free = (n for n in range(last + 1, 10**6) if n not in used)
        for i in range(1, many + 1):
            values.append(("s", kind, f"v{i}", last + i, last))
            want[kind, f"v{i}"] = next(free)
    numbered = spark.createDataFrame(values, "scope_id string, pii_type string, value_lc string, n long, last_n long")
    used = spark.createDataFrame(taken, "scope_id string, pii_type string, n long")
    spans = numbered.selectExpr("scope_id", "pii_type", "value_lc AS text", "n AS doc_id", "0 AS unit_no", "0 AS start")
    given = mapping.assign_placeholders(spans.where("last_n = 0"), taken=used)
    assert "collect_" not in given._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["n"] == want[r["pii_type"], r["value_lc"]] for r in given.collect())
    limits = numbered.groupBy("scope_id", "pii_type", "last_n").count().withColumnRenamed("count", "many")
    for document_scopes in (False, True):
        moved = mapping._around_taken(numbered, used, limits, document_scopes, rows_per_block=16)
        assert moved.columns == numbered.columns
        assert {(r["pii_type"], r["value_lc"]): r["n"] for r in moved.collect()} == want
        assert "collect_" not in moved._jdf.queryExecution().optimizedPlan().toString()


def test_strict_restore_fails_without_mapping(spark):
    units = unit_rows(spark, "x").withColumn("scope_id", F.lit("other"))
    with pytest.raises(PySparkException, match="no mappings"):
        restore_strict(units, handle_mapping(spark)).collect()


# -- sealing ---------------------------------------------------------------------------


def small_mapping(rich):
    mapping = row_mapping(redact_rows(rich), ["doc_id"])
    return mapping.withColumnRenamed("doc_id", "scope_id")


def test_keys_stay_out_of_plans(spark, rich):
    key = bytes(range(32))
    keyring = Keyring.from_key(spark, key)
    plan = seal(small_mapping(rich), keyring)._jdf.queryExecution().toString()
    inner, outer = crypto.hmac_pads(__import__("hashlib").sha256(b"value digest" + key).digest())
    for secret in (key, inner[:32], outer[:32]):
        for shown in (secret.hex(), secret.hex().upper(), repr(secret)[2:-1],
                      " ".join(f"{b:02X}" for b in secret)):
            assert shown not in plan


def test_digest_is_an_hmac(spark):
    import hashlib
    import hmac

    key = bytes(range(32))
    keyring = Keyring.from_key(spark, key)
    df = spark.createDataFrame([("ann@corp.io",), ("Олена",)], "v string")
    got = [r[0] for r in df.select(keyring.digest(F.col("v"))).collect()]
    digest_key = hashlib.sha256(b"value digest" + key).digest()
    assert got == [
        hmac.new(digest_key, v.encode(), "sha256").hexdigest() for v in ("ann@corp.io", "Олена")
    ]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_save_and_load(spark, rich, tmp_path, fmt):
    keyring = Keyring.from_password(spark, "right", rounds=100)
    mapping = small_mapping(rich)
    save_mapping(seal(mapping, keyring), f"{tmp_path}/m", keyring, fmt)
    stored, opened = load_mapping(spark, f"{tmp_path}/m", "right", rounds=100)
    got = unseal(stored, opened).select("scope_id", "pii_type", "original", "n", "placeholder")
    want = mapping.select(*got.columns)
    if fmt == "json":
        got = got.withColumn("scope_id", F.col("scope_id").cast("long"))
    assert want.exceptAll(got).count() == 0 and got.count() == want.count()
    with pytest.raises(ValueError, match="wrong password"):
        load_mapping(spark, f"{tmp_path}/m", "wrong", rounds=100)
    written = "".join(p.read_text("latin-1") for p in tmp_path.rglob("*") if p.is_file())
    assert "@corp.io" not in written


def test_session_mapping_cannot_be_loaded(spark, rich, tmp_path):
    keyring = Keyring.for_session(spark)
    save_mapping(seal(small_mapping(rich), keyring), f"{tmp_path}/m", keyring)
    with pytest.raises(ValueError, match="session-only"):
        load_mapping(spark, f"{tmp_path}/m", "any", rounds=100)


def test_unknown_version_is_refused(spark, tmp_path):
    spark.createDataFrame([('{"version": 2, "salt": "AA=="}',)], "value string").write.text(
        f"{tmp_path}/m/meta"
    )
    with pytest.raises(ValueError, match="version"):
        load_mapping(spark, f"{tmp_path}/m", "any", rounds=100)


def test_wrong_key_fails_loudly(spark, rich):
    sealed = seal(small_mapping(rich), Keyring.from_key(spark, b"a" * 32))
    with pytest.raises(PySparkException, match="wrong password"):
        unseal(sealed, Keyring.from_key(spark, b"b" * 32)).collect()


def test_rows_are_redacted_without_a_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = redact_rows(docs).select("doc_id", "redacted", "total")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown
    # one for each step that is computed once: claims, arbitration, choice,
    # taken numbers, numbering
    assert shown.count("Generate") == 5 and "Python" not in shown
    assert len(shown) < 100_000


def test_small_tables_are_dealt_out(spark, sf_dir):
    """One row group is one task's, however many splits its file has."""
    per_part = documents(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_part) == spark.sparkContext.defaultParallelism
