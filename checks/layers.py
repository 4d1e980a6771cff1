"""Queries on layers that are tables, long texts, taken placeholders and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cloakspan import rules as R
from cloakspan.functions.staging import shared_folder, stage
from cloakspan.operators.crypto import Keyring
from cloakspan.operators.detect import SPAN_FIELDS, rule_hits as rule_hits_of
from cloakspan.operators.dictionary import dictionary_spans
from cloakspan.operators.mapping import assign_placeholders
from cloakspan.operators.redact import (
    ACCEPT_ALL,
    SKIP_UNCERTAIN,
    Layers,
    arbitrate_table,
    decide,
    redact_rows,
    redact_units,
    unit_spans,
)
from cloakspan.operators.restore import restore_units
from cloakspan.plans.corpus import redact_corpus, restore_corpus
from cloakspan.sources.units import whole_units

from .detection import (
    _ACCOUNTS,
    _CUSTOM_CTES,
    _CUSTOM_ROWS,
    RICH,
    _custom_table,
    _entity_rows,
    _entity_sql,
)
from .inputs import (
    ACCOUNT_TEXT,
    ENTITY_TEXT,
    RICH_TEXT,
    derived,
    documents,
    rich_documents,
    sql_text,
    table,
)
from .oracle_parts import CLAIMS, greedy, hits, numbered, placeholder, raw, rule_hits, source, spliced, with_
from .redaction import _LINE_RUN, _MAP, _MAP_COLUMNS, SAFE, _as_units, accepted_sql
from .registry import SPAN_SQL, query, span_columns

# -- long texts ------------------------------------------------------------------------

MAILS = 2_000
_LONG = "concat(text, {tail})"
_SPARK_TAIL = f"array_join(transform(sequence(1, {MAILS}), i -> concat(' a', i, '.', item_id, '@corp.io')), '')"
_SQL_TAIL = (
    f"list_aggregate(list_transform(range(1, {MAILS + 1}), lambda i: "
    "' a' || i || '.' || item_id || '@corp.io'), 'string_agg', '')"
)
_EMAIL = R.RULES_BY_NAME["email"]


@query(
    "detect_long_texts",
    with_(
        source("docs", _LONG.format(tail=_SQL_TAIL), "benchmark", "item_id"),
        rule_hits("h", "docs", _EMAIL),
        select="SELECT doc_id AS item_id, s AS span_start, e AS span_end, t AS text FROM h",
    ),
)
def detect_long_texts(spark, sf_dir):
    """Texts with thousands of hits each."""
    items = table(spark, sf_dir, "benchmark", "item_id")
    long = items.withColumn("text", F.expr(_LONG.format(tail=_SPARK_TAIL)))
    return long.select("item_id", F.expr(f"inline({rule_hits_of('text', _EMAIL)})")).select(
        "item_id", F.col("start").cast("long").alias("span_start"),
        F.col("end").cast("long").alias("span_end"), "text",
    )


# -- dictionaries ----------------------------------------------------------------------------


def _names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.lit("company_name").alias("pii_type"), F.col("c_name").alias("value")
    )


_ACCOUNT_HITS = hits("found", "docs", "(?i)customer#[0-9]{9}")


@query(
    "dictionary_type_ranks",
    with_(
        _ACCOUNTS, _ACCOUNT_HITS,
        select="""SELECT doc_id, s AS span_start, e AS span_end, t AS text,
          CASE WHEN k % 2 = 0 THEN 'team_name' ELSE 'company_name' END AS pii_type
          FROM found JOIN (SELECT DISTINCT lower(c_name) AS v, c_custkey AS k FROM customer)
          ON v = lower(t)""",
    ),
)
def dictionary_type_ranks(spark, sf_dir):
    """One value under two types: the type of the smaller rank claims it."""
    units = whole_units(derived(documents(spark, sf_dir), ACCOUNT_TEXT))
    customer = table(spark, sf_dir, "customer")
    first = customer.selectExpr(
        "if(c_custkey % 2 = 0, 'team_name', 'company_name') AS pii_type", "c_name AS value", "1 AS rank"
    )
    second = customer.selectExpr(
        "if(c_custkey % 2 = 0, 'company_name', 'team_name')", "lower(c_name)", "2"
    )
    spans = dictionary_spans(units, first.union(second))
    return span_columns(arbitrate_table(spans).select("scope_id", "doc_id", "unit_no", *SPAN_FIELDS))


# safe values: as many as eight for a customer, and some that stand in the texts
_SAFE_SQL = """safe AS (SELECT lower(c_name) || '-' || k AS v FROM customer
    CROSS JOIN (SELECT unnest(range(0, 8)) AS k)
    UNION SELECT 'mary.' || cast(doc_id % 50 AS varchar) || '@corp.io' FROM labels WHERE toxic = 1
    UNION SELECT lower(c_name) FROM customer)"""
_EDITS = (
    "edits AS (SELECT a.doc_id, s, e, ph FROM accepted a JOIN mapping m "
    "ON m.scope = a.doc_id AND m.typ = a.typ AND m.key = lower(a.t))"
)
_REDACTED = [
    CLAIMS, *greedy("resolved", "claims", "longest", False),
    "accepted AS (SELECT * FROM resolved WHERE status = 'match')",
    *numbered("accepted", "doc_id", "s"), _EDITS, *spliced("docs", "edits"),
]
_BUSY_TEXT = RICH_TEXT.replace("concat(text,", f"concat({ACCOUNT_TEXT},", 1)


@query(
    "redact_with_dictionary",
    with_(
        source("docs", sql_text(_BUSY_TEXT)), _SAFE_SQL, _ACCOUNT_HITS,
        *raw(
            "docs",
            extra=[
                "SELECT doc_id, s, e, t, 'company_name', 1.0, 1, 0, 6, 'match' FROM found "
                "JOIN (SELECT DISTINCT lower(c_name) AS v FROM customer) ON v = lower(t)"
            ],
        ),
        "kept AS (SELECT * FROM raw WHERE layer = 1 OR lower(t) NOT IN (SELECT v FROM safe))",
        CLAIMS.replace("FROM raw", "FROM kept"), *_REDACTED[1:],
        select="SELECT doc_id, redacted FROM spliced",
    ),
)
def redact_with_dictionary(spark, sf_dir):
    """Learned and safe values, thousands of each, take part in a redaction."""
    units = whole_units(derived(documents(spark, sf_dir), _BUSY_TEXT))
    names = _names(spark, sf_dir)
    counted = names.select(
        F.expr("explode(transform(sequence(0, 7), k -> concat(lower(value), '-', k))) AS value_lc")
    )
    seen = table(spark, sf_dir, "labels").where("toxic = 1").select(
        F.expr("concat('mary.', cast(doc_id % 50 AS string), '@corp.io')")
    )
    safe = counted.union(seen).union(names.select(F.lower("value")))
    run = redact_units(
        units, document_scopes=True, layers=Layers(dictionary=names, safe=safe)
    )
    return run.texts.select("doc_id", "redacted")


_PRIORITY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.TYPE_PRIORITY.items())


@query(
    "redact_with_entities",
    with_(
        source("docs", sql_text(ENTITY_TEXT)),
        f"ent AS ({_entity_sql()})",
        *raw(
            "docs",
            extra=[
                f"SELECT doc_id, span_start, span_end, text, pii_type, confidence, 4, 0, "
                f"CASE pii_type {_PRIORITY} END, status FROM ent"
            ],
        ),
        *_REDACTED,
        select="SELECT doc_id, redacted FROM spliced",
    ),
)
def redact_with_entities(spark, sf_dir):
    """Entities of a user's model take part in a redaction."""
    units = whole_units(derived(documents(spark, sf_dir), ENTITY_TEXT))
    entities = _entity_rows(spark, sf_dir).withColumn("scope_id", F.col("doc_id"))
    run = redact_units(units, document_scopes=True, layers=Layers(entities=entities))
    return run.texts.select("doc_id", "redacted")


@query(
    "redact_with_patterns",
    with_(
        RICH, *_CUSTOM_CTES, *raw("docs", extra=_CUSTOM_ROWS), *_REDACTED,
        select="SELECT doc_id, redacted FROM spliced",
    ),
)
def redact_with_patterns(spark, sf_dir):
    """Custom patterns of a table take part in a redaction."""
    units = whole_units(rich_documents(spark, sf_dir))
    patterns = _custom_table(spark, sf_dir)
    run = redact_units(units, document_scopes=True, layers=Layers(patterns=patterns))
    return run.texts.select("doc_id", "redacted")


# -- placeholders that stand in the source ----------------------------------------------------

_TAKEN_TEXT = RICH_TEXT.replace(
    "concat(text,", "concat(text, ' ref 555-000-0001x, 555-000-0003x and XXX-XX-0002y, '," , 1
)
_SKIPPED = """CASE typ WHEN 'phone' THEN n + 1 + CAST(n > 1 AS INTEGER)
  WHEN 'ssn' THEN n + CAST(n > 1 AS INTEGER) ELSE n END"""
_TAKEN_SQL = with_(
    source("docs", sql_text(_TAKEN_TEXT)), *accepted_sql(SKIP_UNCERTAIN, SAFE),
    *numbered("accepted", "doc_id", "s", name="dense"),
    f"mapping AS (SELECT scope, typ, key, {placeholder('typ', f'({_SKIPPED})')} AS ph FROM dense)",
    _EDITS, *spliced("docs", "edits"),
    select="SELECT doc_id, redacted FROM spliced",
)


@query("redact_with_taken_placeholders", _TAKEN_SQL)
def redact_with_taken_placeholders(spark, sf_dir):
    """A number whose placeholder stands in the text is not given out."""
    docs = derived(documents(spark, sf_dir), _TAKEN_TEXT)
    return redact_rows(docs).select("doc_id", "redacted")


@query("redact_units_with_taken_placeholders", _TAKEN_SQL)
def redact_units_with_taken_placeholders(spark, sf_dir):
    units = whole_units(derived(documents(spark, sf_dir), _TAKEN_TEXT))
    return redact_units(units, document_scopes=True).texts.select("doc_id", "redacted")


@query(
    "restore_with_taken_placeholders",
    f"SELECT doc_id, {sql_text(_TAKEN_TEXT)} AS restored, true AS changed FROM documents",
)
def restore_with_taken_placeholders(spark, sf_dir):
    """One scope for the corpus, redacted and restored: the very source."""
    units = whole_units(derived(documents(spark, sf_dir), _TAKEN_TEXT), scope=F.lit("corpus"))
    run = redact_units(units)
    changed = run.texts.withColumn("changed", F.col("redacted") != F.col("text"))
    restored = restore_units(_as_units(changed, "redacted"), run.mapping)
    return restored.select("doc_id", "restored", "changed")


# -- a value in a third of all spans -----------------------------------------------------------

_COMMON_TEXT = RICH_TEXT.replace(
    "concat(text,", "concat(text, ' office@corp.io, office@corp.io; OFFICE@corp.io or '," , 1
)


@query(
    "redact_common_value",
    with_(
        source("docs", sql_text(_COMMON_TEXT)), *accepted_sql(SKIP_UNCERTAIN, SAFE),
        *numbered("accepted", "'corpus'", "doc_id * 10000000 + s"),
        "edits AS (SELECT a.doc_id, s, e, ph FROM accepted a JOIN mapping m "
        "ON m.typ = a.typ AND m.key = lower(a.t))",
        *spliced("docs", "edits"),
        select="SELECT doc_id, redacted FROM spliced",
    ),
)
def redact_common_value(spark, sf_dir):
    """One corpus-wide value fills about a third of all spans."""
    units = whole_units(derived(documents(spark, sf_dir), _COMMON_TEXT), scope=F.lit("corpus"))
    return redact_units(units).texts.select("doc_id", "redacted")


# -- ids of any kind ------------------------------------------------------------------------------

_SPARSE = "((doc_id * 7919 + 13) % 1000003) * 1000000007"


def _mapping_by(order: str) -> str:
    return with_(
        RICH, *accepted_sql(ACCEPT_ALL, SAFE), *numbered("accepted", "'corpus'", order),
        select=f"SELECT {_MAP} FROM mapping",
    )


def _mapping_with_ids(spark, sf_dir, new_id: str):
    docs = rich_documents(spark, sf_dir).withColumn("doc_id", F.expr(new_id))
    spans = unit_spans(whole_units(docs, scope=F.lit("corpus")), mode=ACCEPT_ALL)
    accepted = stage(decide(spans, ACCEPT_ALL), "spans")
    return assign_placeholders(accepted).select(*_MAP_COLUMNS)


@query(
    "mapping_of_sparse_ids",
    _mapping_by(f"CAST({_SPARSE} AS HUGEINT) * 10000000 + s"),
)
def mapping_of_sparse_ids(spark, sf_dir):
    """Ids spread over a wide range number in their order."""
    return _mapping_with_ids(spark, sf_dir, _SPARSE)


@query(
    "mapping_of_text_ids",
    _mapping_by("rpad('d' || doc_id, 20, ' ') || lpad(CAST(s AS VARCHAR), 10, '0')"),
)
def mapping_of_text_ids(spark, sf_dir):
    """Text ids number in text order."""
    return _mapping_with_ids(spark, sf_dir, "concat('d', doc_id)")


# -- whole runs ------------------------------------------------------------------------------------


@query(
    "restore_paragraphs",
    with_(
        *_LINE_RUN,
        "first_case AS (SELECT a.doc_id, s, e, original AS ph FROM spans a JOIN mapping m "
        "ON m.scope = a.doc AND m.typ = a.typ AND m.key = lower(a.t))",
        *spliced("docs", "first_case", name="again", out="restored"),
        select="""SELECT doc_id // 1000000 AS doc_id,
          string_agg(restored, chr(10) ORDER BY doc_id % 1000000) AS text,
          CAST(0 AS BIGINT) AS mappings_left FROM again GROUP BY doc_id // 1000000""",
    ),
)
def restore_paragraphs(spark, sf_dir):
    """Redact to files, restore from the files and the saved mapping, join."""
    out = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    docs = rich_documents(spark, sf_dir).select("doc_id", "text")
    keyring = Keyring.from_password(spark, "password of the run", rounds=1000)
    redact_corpus(docs, out, keyring, mode=ACCEPT_ALL)
    left = restore_corpus(
        spark.read.parquet(f"{out}/texts"), f"{out}/mapping", f"{out}/restored",
        "password of the run", rounds=1000,
    )
    texts = spark.read.parquet(f"{out}/restored").select("doc_id", "text")
    return texts.crossJoin(left.agg(F.count("*").alias("mappings_left")))
