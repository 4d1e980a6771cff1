"""Decisions, mapping, redaction, restoration, sessions, streams."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from cloakspan.functions.staging import shared_folder, stage
from cloakspan.operators.crypto import Keyring, hmac_pads
from cloakspan.operators.mapping import (
    assign_placeholders,
    clear_scopes,
    extend_mapping,
    load_mapping,
    mapping_stats,
    original_of,
    placeholder_of,
    restorations,
    save_mapping,
    seal,
    unseal,
    verify_values,
)
from cloakspan.operators.redact import (
    ACCEPT_ALL,
    REVIEWED,
    SKIP_UNCERTAIN,
    Policy,
    decide,
    redact_rows,
    redact_units,
    row_mapping,
    unit_spans,
)
from cloakspan.operators.report import document_report, type_counts, unit_stats
from cloakspan.operators.restore import (
    restore_units,
    restore_units_sequential,
    split_unknown_scopes,
)
from cloakspan.operators.review import review_queue
from cloakspan.plans.sessions import (
    confirm,
    drop_expired,
    open_sessions,
    session_units,
    start_sessions,
)
from cloakspan.sources.tables import redact_table, restore_table
from cloakspan.sources.units import join_units, split_units, whole_units
from cloakspan.streaming.sessions import redact_stream

from .detection import RICH
from .inputs import (
    RICH_TEXT,
    SESSION_TEXT,
    conversations,
    rich_documents,
    sql_text,
    table,
)
from .oracle_parts import (
    CLAIMS,
    greedy,
    numbered,
    placeholder,
    raw,
    source,
    spliced,
    with_,
)
from .registry import SPAN_SQL, query, span_columns

SAFE = Policy()
REFERENCE = Policy.reference()


def accepted_sql(mode: str, policy: Policy, name: str = "accepted") -> list[str]:
    """CTEs from ``docs`` to the accepted spans."""
    ctes = [
        *raw("docs"), CLAIMS,
        *greedy("resolved", "claims", policy.order, policy.repeats == "first"),
    ]
    if mode == SKIP_UNCERTAIN:
        return [*ctes, f"{name} AS (SELECT * FROM resolved WHERE status = 'match')"]
    if policy.sequential_splice:
        return [*ctes, f"{name} AS (SELECT * FROM resolved)"]
    return [*ctes, *greedy(name, "resolved", policy.order, False, by_status=False)]


# -- decisions -------------------------------------------------------------------------


def _register_mode(mode: str) -> None:
    @query(
        f"decide_{mode}",
        with_(RICH, *accepted_sql(mode, SAFE), select=f"SELECT {SPAN_SQL} FROM accepted"),
    )
    def decided(spark, sf_dir):
        spans = unit_spans(whole_units(rich_documents(spark, sf_dir)), mode=mode)
        return span_columns(decide(spans, mode))


for _mode in (SKIP_UNCERTAIN, ACCEPT_ALL):
    _register_mode(_mode)

# quality 1 accepts Karl Wagner (as a company where also toxic), quality 0 refuses
_DECISIONS = """SELECT doc_id AS scope_id, 'person_name' AS pii_type, 'Karl Wagner' AS value,
  CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS decision,
  CASE WHEN toxic = 1 THEN 'company_name' END AS type_override FROM labels"""
_REVIEWED = [
    RICH, *raw("docs"), CLAIMS, *greedy("resolved", "claims", "longest", False),
    f"decisions AS ({_DECISIONS})",
    """yes AS (SELECT doc_id, s, e, t, coalesce(d.type_override, typ) AS typ, conf, layer, seq,
         prio, status FROM resolved r JOIN decisions d ON d.scope_id = r.doc_id
         AND d.pii_type = r.typ AND d.value = r.t
         WHERE d.decision = 'yes' AND status = 'uncertain'
         UNION ALL SELECT * FROM resolved WHERE status = 'match')""",
    *greedy("accepted", "yes", "longest", False, by_status=False),
]


def _decisions(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    labels.createOrReplaceTempView("review_labels")
    return spark.sql(_DECISIONS.replace("FROM labels", "FROM review_labels"))


@query(
    "decide_reviewed", with_(*_REVIEWED, select=f"SELECT {SPAN_SQL} FROM accepted")
)
def decide_reviewed(spark, sf_dir):
    spans = unit_spans(whole_units(rich_documents(spark, sf_dir)), mode=REVIEWED)
    return span_columns(decide(spans, REVIEWED, decisions=_decisions(spark, sf_dir)))


# three decisions on each document's name, at times whose order differs by document
_CONFLICTS = """SELECT doc_id AS scope_id, 'person_name' AS pii_type, 'Karl Wagner' AS value,
  CASE (doc_id * 7 + k * k) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'skip' END AS decision,
  CASE (doc_id + k) % 3 WHEN 0 THEN 'company_name' WHEN 1 THEN 'team_name' END AS type_override,
  (doc_id * 5 + k * 3) % 11 AS decided_at
  FROM {documents} CROSS JOIN {times}"""


@query(
    "decide_reviewed_conflicts",
    with_(
        RICH, *raw("docs"), CLAIMS, *greedy("resolved", "claims", "longest", False),
        "said AS ({})".format(
            _CONFLICTS.format(documents="documents", times="(SELECT unnest([0, 1, 2]) AS k)")
        ),
        """decisions AS (SELECT * FROM (
             SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY decided_at DESC,
               decision DESC, type_override DESC NULLS LAST) AS back
             FROM said WHERE decision <> 'skip') WHERE back = 1)""",
        *_REVIEWED[-4:],
        select=f"SELECT {SPAN_SQL} FROM accepted",
    ),
)
def decide_reviewed_conflicts(spark, sf_dir):
    """Yes, no and skip on the same value: the last yes or no counts."""
    table(spark, sf_dir, "documents").select("doc_id").createOrReplaceTempView("review_documents")
    said = spark.sql(
        _CONFLICTS.format(
            documents="review_documents", times="(SELECT explode(array(0, 1, 2)) AS k)"
        )
    )
    spans = unit_spans(whole_units(rich_documents(spark, sf_dir)), mode=REVIEWED)
    return span_columns(decide(spans, REVIEWED, decisions=said))


@query(
    "redact_reviewed",
    with_(
        *_REVIEWED,
        *numbered("accepted", "doc_id", "s"),
        "edits AS (SELECT a.doc_id, s, e, ph FROM accepted a JOIN mapping m "
        "ON m.scope = a.doc_id AND m.typ = a.typ AND m.key = lower(a.t))",
        *spliced("docs", "edits"),
        select="SELECT doc_id, redacted FROM spliced",
    ),
)
def redact_reviewed(spark, sf_dir):
    units = whole_units(rich_documents(spark, sf_dir))
    run = redact_units(
        units, mode=REVIEWED, decisions=_decisions(spark, sf_dir), document_scopes=True
    )
    return run.texts.select("doc_id", "redacted")


# -- mapping -----------------------------------------------------------------------------


def _mapping_sql(scope: str, order: str, policy: Policy, columns: str) -> str:
    return with_(
        RICH, *accepted_sql(ACCEPT_ALL, policy), *numbered("accepted", scope, order),
        select=f"SELECT {columns} FROM mapping",
    )


_MAP = (
    "scope AS scope_id, typ AS pii_type, key AS value_lc, original, "
    "CAST(n AS BIGINT) AS n, ph AS placeholder"
)
_MAP_COLUMNS = ["scope_id", "pii_type", "value_lc", "original", "n", "placeholder"]


def _row_mapping(spark, sf_dir, policy):
    redacted = redact_rows(rich_documents(spark, sf_dir), policy=policy, mode=ACCEPT_ALL)
    return row_mapping(redacted, ["doc_id"]).withColumnRenamed("doc_id", "scope_id")


@query("mapping_of_documents", _mapping_sql("doc_id", "s", SAFE, _MAP))
def mapping_of_documents(spark, sf_dir):
    return _row_mapping(spark, sf_dir, SAFE)


@query("mapping_of_documents_reference", _mapping_sql("doc_id", "-s", REFERENCE, _MAP))
def mapping_of_documents_reference(spark, sf_dir):
    return _row_mapping(spark, sf_dir, REFERENCE)


def _corpus_units(spark, sf_dir):
    return whole_units(rich_documents(spark, sf_dir), scope=F.lit("corpus"))


@query(
    "mapping_of_corpus", _mapping_sql("'corpus'", "doc_id * 10000000 + s", SAFE, _MAP)
)
def mapping_of_corpus(spark, sf_dir):
    """One scope for all documents, numbered without one task per type."""
    spans = unit_spans(_corpus_units(spark, sf_dir), mode=ACCEPT_ALL)
    accepted = stage(decide(spans, ACCEPT_ALL), "spans")
    return assign_placeholders(accepted).select(*_MAP_COLUMNS)


@query(
    "mapping_of_corpus_reference",
    _mapping_sql("'corpus'", "doc_id * 10000000 + (5000000 - s)", REFERENCE, _MAP),
)
def mapping_of_corpus_reference(spark, sf_dir):
    spans = unit_spans(_corpus_units(spark, sf_dir), policy=REFERENCE, mode=ACCEPT_ALL)
    accepted = stage(decide(spans, ACCEPT_ALL, REFERENCE), "spans")
    return assign_placeholders(accepted, "reference").select(*_MAP_COLUMNS)


@query(
    "mapping_with_custom_placeholders",
    with_(
        RICH, *accepted_sql(SKIP_UNCERTAIN, SAFE),
        "plain AS (SELECT * FROM accepted WHERE typ <> 'url')",
        *numbered("plain", "doc_id", "s"),
        *numbered("accepted", "doc_id", "s", name="every"),
        select=f"SELECT {_MAP} FROM mapping UNION ALL SELECT scope, typ, key, original, "
        "CAST(NULL AS BIGINT), '<link ' || length(original) || '>' FROM every WHERE typ = 'url'",
    ),
)
def mapping_with_custom_placeholders(spark, sf_dir):
    """URLs get a chosen placeholder and take no number."""
    spans = unit_spans(whole_units(rich_documents(spark, sf_dir)))
    custom = F.when(
        F.col("pii_type") == "url",
        F.concat(F.lit("<link "), F.length("text").cast("string"), F.lit(">")),
    )
    accepted = decide(spans, SKIP_UNCERTAIN).withColumn("custom", custom)
    return assign_placeholders(
        stage(accepted, "spans"), document_scopes=True
    ).select(*_MAP_COLUMNS)


def _turn_spans(half: str) -> str:
    """Accepted spans of the session turns of one half (even or odd turns)."""
    return f"SELECT *, doc_id // 1000 AS conv, doc_id % 1000 AS turn FROM accepted WHERE doc_id % 2 = {half}"


_TURNS = source("docs", sql_text(SESSION_TEXT), "conversations", "conv_id * 1000 + turn")


@query(
    "mapping_incremental",
    with_(
        _TURNS, *accepted_sql(SKIP_UNCERTAIN, SAFE),
        f"old AS ({_turn_spans('0')})", f"new AS ({_turn_spans('1')})",
        *numbered("old", "conv", "turn * 10000000 + s", name="known"),
        """fresh AS (SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM known k
           WHERE k.scope = n.conv AND k.typ = n.typ AND k.key = lower(n.t)))""",
        *numbered("fresh", "conv", "turn * 10000000 + s", name="added"),
        select=f"""SELECT a.scope AS scope_id, a.typ AS pii_type, a.key AS value_lc, a.original,
          CAST(a.n + coalesce(l.last, 0) AS BIGINT) AS n,
          {placeholder('a.typ', '(a.n + coalesce(l.last, 0))')} AS placeholder
          FROM added a LEFT JOIN (SELECT scope, typ, max(n) AS last FROM known GROUP BY ALL) l
          ON l.scope = a.scope AND l.typ = a.typ""",
    ),
)
def mapping_incremental(spark, sf_dir):
    """Odd turns continue the mapping of the even turns."""
    units = session_units(conversations(spark, sf_dir), "conv_id", "turn")
    spans = stage(decide(unit_spans(units), SKIP_UNCERTAIN), "spans")
    known = assign_placeholders(spans.where("unit_no % 2 = 0"), document_scopes=True)
    added = extend_mapping(known, spans.where("unit_no % 2 = 1"), document_scopes=True)
    return added.select(*_MAP_COLUMNS)


# -- sealing -------------------------------------------------------------------------------

TEST_KEY = hashlib.sha256(b"fixed key of the registered queries").digest()
_DOC_MAP = [RICH, *accepted_sql(SKIP_UNCERTAIN, SAFE), *numbered("accepted", "doc_id", "s")]


def _doc_mapping(spark, sf_dir):
    redacted = redact_rows(rich_documents(spark, sf_dir))
    return row_mapping(redacted, ["doc_id"]).withColumnRenamed("doc_id", "scope_id")


@query("seal_and_unseal", with_(*_DOC_MAP, select=f"SELECT {_MAP} FROM mapping").replace(
    "key AS value_lc, ", ""))
def seal_and_unseal(spark, sf_dir):
    keyring = Keyring.from_key(spark, TEST_KEY)
    sealed = seal(_doc_mapping(spark, sf_dir), keyring)
    return unseal(sealed, keyring).select(
        "scope_id", "pii_type", "original", "n", "placeholder"
    )


def _digest_sql(value: str) -> str:
    inner, outer = hmac_pads(hashlib.sha256(b"value digest" + TEST_KEY).digest())
    inside = f"sha256(unhex('{inner.hex()}') || encode({value}))"
    return f"sha256(unhex('{outer.hex()}') || unhex({inside}))"


@query(
    "value_digests",
    with_(
        *_DOC_MAP,
        select=f"""SELECT scope_id, pii_type, value_key, placeholder,
          md5(concat_ws('|', cast(scope_id AS varchar), pii_type, value_key)) AS mapping_id
          FROM (SELECT scope AS scope_id, typ AS pii_type, ph AS placeholder,
                {_digest_sql('key')} AS value_key FROM mapping)""",
    ),
)
def value_digests(spark, sf_dir):
    sealed = seal(_doc_mapping(spark, sf_dir), Keyring.from_key(spark, TEST_KEY))
    return sealed.select("scope_id", "pii_type", "value_key", "placeholder", "mapping_id")


_ASKED = (
    "SELECT doc_id AS scope_id, 'email' AS pii_type, "
    "'MARY.' || cast((doc_id + toxic) % 50 AS {string}) || '@corp.io' AS value FROM {labels}"
)


def _asked(spark, sf_dir):
    table(spark, sf_dir, "labels").createOrReplaceTempView("asked_labels")
    return spark.sql(_ASKED.format(string="string", labels="asked_labels"))


_ASKED_SQL = f"asked AS ({_ASKED.format(string='varchar', labels='labels')})"


@query(
    "verify_values",
    with_(
        *_DOC_MAP, _ASKED_SQL,
        select="""SELECT scope_id, pii_type, value, m.key IS NOT NULL AS known FROM asked
          LEFT JOIN mapping m ON m.scope = scope_id AND m.typ = pii_type AND m.key = lower(value)""",
    ),
)
def verified_values(spark, sf_dir):
    keyring = Keyring.from_key(spark, TEST_KEY)
    sealed = stage(seal(_doc_mapping(spark, sf_dir), keyring), "sealed")
    return verify_values(sealed, _asked(spark, sf_dir), keyring)


@query(
    "placeholder_of_values",
    with_(
        *_DOC_MAP, _ASKED_SQL,
        select="""SELECT scope_id, pii_type, value, m.ph AS placeholder FROM asked
          LEFT JOIN mapping m ON m.scope = scope_id AND m.typ = pii_type AND m.key = lower(value)""",
    ),
)
def placeholder_of_values(spark, sf_dir):
    return placeholder_of(_asked(spark, sf_dir), _doc_mapping(spark, sf_dir))


# every value under its type's name as a custom placeholder, so that they collide
_SHARED = [
    RICH, *accepted_sql(SKIP_UNCERTAIN, SAFE),
    """vals AS (SELECT scope, typ, key, original, ord FROM (
         SELECT doc_id AS scope, typ, lower(t) AS key, t AS original, s AS ord,
           row_number() OVER (PARTITION BY doc_id, typ, lower(t) ORDER BY s) AS rn
         FROM accepted) WHERE rn = 1)""",
]


def _shared_mapping(spark, sf_dir):
    spans = unit_spans(whole_units(rich_documents(spark, sf_dir)))
    accepted = decide(spans, SKIP_UNCERTAIN).withColumn(
        "custom", F.concat(F.lit("<"), "pii_type", F.lit(">"))
    )
    return assign_placeholders(stage(accepted, "spans"), document_scopes=True)


@query(
    "original_of_placeholders",
    with_(
        *_SHARED,
        select="""SELECT scope AS scope_id, '<' || typ || '>' AS placeholder,
          arg_min(original, ord) AS original, typ AS pii_type FROM vals GROUP BY scope, typ""",
    ),
)
def original_of_placeholders(spark, sf_dir):
    return original_of(_shared_mapping(spark, sf_dir))


@query(
    "restorations_of_placeholders",
    with_(
        *_SHARED,
        select="""SELECT scope AS scope_id, '<' || typ || '>' AS placeholder,
          arg_max(original, ord) AS original FROM vals GROUP BY scope, typ""",
    ),
)
def restorations_of_placeholders(spark, sf_dir):
    return restorations(_shared_mapping(spark, sf_dir))


def _register_sealed(name: str, sql: str, look_up) -> None:
    @query(name, with_(*_SHARED, select=sql))
    def sealed_lookup(spark, sf_dir):
        """The sealed mapping keeps the order in which values were mapped."""
        keyring = Keyring.from_key(spark, TEST_KEY)
        made_at = F.lit("2024-01-01").cast("timestamp")
        sealed = seal(_shared_mapping(spark, sf_dir), keyring, made_at)
        return unseal(look_up(sealed, "original_enc"), keyring)


_register_sealed(
    "original_of_sealed",
    """SELECT scope AS scope_id, '<' || typ || '>' AS placeholder,
       arg_min(original, ord) AS original, typ AS pii_type FROM vals GROUP BY scope, typ""",
    original_of,
)
_register_sealed(
    "restorations_of_sealed",
    """SELECT scope AS scope_id, '<' || typ || '>' AS placeholder,
       arg_max(original, ord) AS original FROM vals GROUP BY scope, typ""",
    restorations,
)


@query(
    "save_and_load_mapping",
    with_(*_DOC_MAP, select=f"SELECT {_MAP} FROM mapping").replace("key AS value_lc, ", ""),
)
def save_and_load_mapping(spark, sf_dir):
    """Write the sealed mapping under a password, load it, decrypt it."""
    keyring = Keyring.from_password(spark, "password of the check", rounds=1000)
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    save_mapping(seal(_doc_mapping(spark, sf_dir), keyring), path, keyring)
    stored, opened = load_mapping(spark, path, "password of the check", rounds=1000)
    return unseal(stored, opened).select(
        "scope_id", "pii_type", "original", "n", "placeholder"
    )


@query(
    "mapping_stats",
    with_(
        *_DOC_MAP,
        select="SELECT typ AS pii_type, count(*) AS mappings FROM mapping GROUP BY ROLLUP (typ)",
    ),
)
def stats_of_mapping(spark, sf_dir):
    return mapping_stats(_doc_mapping(spark, sf_dir))


@query(
    "clear_scopes",
    with_(
        *_DOC_MAP,
        select=f"SELECT {_MAP} FROM mapping WHERE scope NOT IN "
        "(SELECT doc_id FROM labels WHERE toxic = 1)",
    ),
)
def cleared_scopes(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    return clear_scopes(
        _doc_mapping(spark, sf_dir), gone.select(F.col("doc_id").alias("scope_id"))
    ).select(*_MAP_COLUMNS)


_NOW = "2024-01-01 02:00:00"


@query(
    "live_sessions",
    f"""WITH s AS (SELECT user_id AS session_id, min(ts) AS created_at,
           min(ts) + INTERVAL 1 HOUR AS expires_at FROM events GROUP BY user_id),
         m AS (SELECT user_id, count(*) AS mappings FROM events GROUP BY user_id)
    SELECT session_id, created_at, expires_at, mappings FROM s JOIN m ON user_id = session_id
    WHERE expires_at >= TIMESTAMP '{_NOW}'""",
)
def live_sessions_of_events(spark, sf_dir):
    """Live sessions, and what is left of a mapping with a row for each event."""
    events = table(spark, sf_dir, "events")
    sessions = open_sessions(events, "user_id", F.col("ts"))
    mapping = events.select(F.col("user_id").alias("scope_id"), "event_id")
    live, left = drop_expired(mapping, sessions, F.expr(f"timestamp '{_NOW}'"))
    counts = left.groupBy(F.col("scope_id").alias("session_id")).agg(
        F.count("*").alias("mappings")
    )
    return live.join(counts, "session_id", "full")


# -- redaction ------------------------------------------------------------------------------


def _redact_sql(mode: str, policy: Policy, text: str = RICH) -> str:
    return with_(
        text, *accepted_sql(mode, policy),
        *numbered("accepted", "doc_id", "s" if policy.numbering == "reading" else "-s"),
        "edits AS (SELECT a.doc_id, s, e, ph FROM accepted a JOIN mapping m "
        "ON m.scope = a.doc_id AND m.typ = a.typ AND m.key = lower(a.t))",
        *spliced("docs", "edits"),
        select="""SELECT doc_id, redacted,
          (SELECT count(*) FROM accepted a WHERE a.doc_id = p.doc_id) AS total,
          (SELECT count(*) FROM resolved r WHERE r.doc_id = p.doc_id
             AND r.status = 'uncertain') AS uncertain
          FROM spliced p""",
    )


def _redacted(spark, sf_dir, **options):
    redacted = redact_rows(rich_documents(spark, sf_dir), **options)
    return redacted.select("doc_id", "redacted", "total", "uncertain")


@query("redact_documents", _redact_sql(SKIP_UNCERTAIN, SAFE))
def redact_documents(spark, sf_dir):
    return _redacted(spark, sf_dir)


@query("redact_documents_all", _redact_sql(ACCEPT_ALL, SAFE))
def redact_documents_all(spark, sf_dir):
    return _redacted(spark, sf_dir, mode=ACCEPT_ALL)


@query("redact_documents_reference", _redact_sql(SKIP_UNCERTAIN, REFERENCE))
def redact_documents_reference(spark, sf_dir):
    return _redacted(spark, sf_dir, policy=REFERENCE)


@query(
    "redact_type_counts",
    with_(
        RICH, *accepted_sql(SKIP_UNCERTAIN, SAFE),
        select="SELECT doc_id, typ AS pii_type, count(*) AS redacted FROM accepted GROUP BY ALL",
    ),
)
def redact_type_counts(spark, sf_dir):
    redacted = redact_rows(rich_documents(spark, sf_dir))
    return redacted.select("doc_id", F.explode("by_type").alias("pii_type", "redacted"))


_LINES = f"""docs AS (SELECT doc_id * 1000000 + i - 1 AS doc_id, line AS text FROM (
  SELECT doc_id, unnest(string_split({sql_text(RICH_TEXT)}, chr(10))) AS line,
    generate_subscripts(string_split({sql_text(RICH_TEXT)}, chr(10)), 1) AS i FROM documents))"""
_LINE_RUN = [
    _LINES, *accepted_sql(ACCEPT_ALL, SAFE),
    "spans AS (SELECT *, doc_id // 1000000 AS doc, doc_id % 1000000 AS unit FROM accepted)",
    *numbered("spans", "doc", "unit * 10000000 + s"),
    "edits AS (SELECT a.doc_id, doc, unit, s, e, a.typ, ph FROM spans a JOIN mapping m "
    "ON m.scope = a.doc AND m.typ = a.typ AND m.key = lower(a.t))",
]


def _line_run(spark, sf_dir):
    units = split_units(rich_documents(spark, sf_dir))
    return units, redact_units(units, mode=ACCEPT_ALL, document_scopes=True)


@query(
    "redact_paragraphs",
    with_(
        *_LINE_RUN, *spliced("docs", "edits"),
        select="""SELECT doc_id // 1000000 AS doc_id,
          string_agg(redacted, chr(10) ORDER BY doc_id % 1000000) AS text
          FROM spliced GROUP BY doc_id // 1000000""",
    ),
)
def redact_paragraphs(spark, sf_dir):
    """Documents cut into lines, redacted with one mapping each, put together."""
    _, run = _line_run(spark, sf_dir)
    return join_units(run.texts, text="redacted")


@query(
    "unit_stats",
    with_(
        *_LINE_RUN,
        select="""SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 AS unit_no,
          coalesce(redacted, 0) AS redacted, coalesce(uncertain, 0) AS uncertain FROM
          (SELECT doc_id, count(*) AS redacted FROM accepted GROUP BY doc_id)
          FULL JOIN (SELECT doc_id, count(*) FILTER (status = 'uncertain') AS uncertain
                     FROM resolved GROUP BY doc_id) USING (doc_id)""",
    ),
)
def stats_of_units(spark, sf_dir):
    _, run = _line_run(spark, sf_dir)
    stats = unit_stats(run.spans, run.edits)
    return stats.select(
        "doc_id", F.col("unit_no").cast("long").alias("unit_no"), "redacted", "uncertain"
    )


@query(
    "document_report",
    with_(
        *_LINE_RUN,
        select="""SELECT d.doc AS doc_id, coalesce(total, 0) AS total,
          coalesce(uncertain, 0) AS uncertain, n_units, coalesce(emails, 0) AS emails FROM
          (SELECT doc_id // 1000000 AS doc, count(*) AS n_units FROM docs GROUP BY doc) d
          LEFT JOIN (SELECT doc, count(*) AS total, count(*) FILTER (typ = 'email') AS emails
                     FROM edits GROUP BY doc) e USING (doc)
          LEFT JOIN (SELECT doc_id // 1000000 AS doc, count(*) FILTER (status = 'uncertain')
                     AS uncertain FROM resolved GROUP BY doc) r USING (doc)""",
    ),
)
def report_of_documents(spark, sf_dir):
    units, run = _line_run(spark, sf_dir)
    report = document_report(units, run.spans, run.edits)
    emails = F.coalesce(F.try_element_at("by_type", F.lit("email")), F.lit(0).cast("long"))
    return report.select("doc_id", "total", "uncertain", "n_units", emails.alias("emails"))


_CORPUS_RUN = [
    RICH, *accepted_sql(ACCEPT_ALL, SAFE),
    *numbered("accepted", "'corpus'", "doc_id * 10000000 + s"),
    "edits AS (SELECT a.doc_id, s, e, a.typ, ph FROM accepted a JOIN mapping m "
    "ON m.typ = a.typ AND m.key = lower(a.t))",
]


@query(
    "redact_corpus",
    with_(
        *_CORPUS_RUN, *spliced("docs", "edits"), select="SELECT doc_id, redacted FROM spliced"
    ),
)
def redact_corpus(spark, sf_dir):
    """The same value has the same placeholder in every document."""
    run = redact_units(_corpus_units(spark, sf_dir), mode=ACCEPT_ALL)
    return run.texts.select("doc_id", "redacted")


@query(
    "corpus_type_counts",
    with_(
        *_CORPUS_RUN,
        select="SELECT typ AS pii_type, count(*) AS redacted FROM edits GROUP BY typ",
    ),
)
def corpus_type_counts(spark, sf_dir):
    run = redact_units(_corpus_units(spark, sf_dir), mode=ACCEPT_ALL)
    return type_counts(run.edits, []).select("pii_type", "redacted")


_CELLS = """docs AS (
  SELECT page_id * 10 AS doc_id, url AS text FROM pages
  UNION ALL SELECT page_id * 10 + 1, html FROM pages)"""
_CELL_RUN = [
    _CELLS, *accepted_sql(SKIP_UNCERTAIN, SAFE),
    *numbered("accepted", "'table'", "doc_id * 10000000 + s"),
    "edits AS (SELECT a.doc_id, s, e, ph FROM accepted a JOIN mapping m "
    "ON m.typ = a.typ AND m.key = lower(a.t))",
    *spliced("docs", "edits"),
]


@query(
    "redact_table",
    with_(
        *_CELL_RUN,
        select="""SELECT u.doc_id // 10 AS page_id, u.redacted AS url, h.redacted AS html
          FROM spliced u JOIN spliced h ON h.doc_id = u.doc_id + 1 AND u.doc_id % 10 = 0""",
    ),
)
def redacted_table(spark, sf_dir):
    redacted, _ = redact_table(table(spark, sf_dir, "pages", "page_id"), "page_id")
    return redacted


@query(
    "restore_table",
    with_(
        *_CELL_RUN,
        select="""SELECT p.page_id, p.url, p.html, u.redacted AS was_url,
          (SELECT count(*) FROM accepted a WHERE a.doc_id // 10 = p.page_id) AS restorations
          FROM pages p JOIN spliced u ON u.doc_id = p.page_id * 10""",
    ),
)
def restored_table(spark, sf_dir):
    """Redact the table and restore it from its mapping."""
    pages = table(spark, sf_dir, "pages", "page_id")
    redacted, mapping = redact_table(pages, "page_id")
    restored, counts = restore_table(redacted, "page_id", mapping)
    was = redacted.select("page_id", F.col("url").alias("was_url"))
    return restored.join(was, "page_id").join(counts, "page_id", "left").withColumn(
        "restorations", F.coalesce("restorations", F.lit(0).cast("long"))
    )


# -- restoration ------------------------------------------------------------------------------


def _as_units(texts, column: str):
    return texts.drop("text").withColumnRenamed(column, "text")


@query(
    "restore_documents",
    with_(
        RICH, *accepted_sql(ACCEPT_ALL, SAFE), *numbered("accepted", "doc_id", "s"),
        "first_case AS (SELECT a.doc_id, s, e, original AS ph FROM accepted a JOIN mapping m "
        "ON m.scope = a.doc_id AND m.typ = a.typ AND m.key = lower(a.t))",
        *spliced("docs", "first_case", out="restored"),
        select="""SELECT doc_id, restored, coalesce(n, 0) AS restorations FROM spliced
          LEFT JOIN (SELECT doc_id, count(*) AS n FROM accepted GROUP BY doc_id) USING (doc_id)""",
    ),
)
def restore_documents(spark, sf_dir):
    """Redact, then restore: the source text in the first-seen casing."""
    units = whole_units(rich_documents(spark, sf_dir))
    run = redact_units(units, mode=ACCEPT_ALL, document_scopes=True)
    restored = restore_units(_as_units(run.texts, "redacted"), run.mapping)
    return restored.select("doc_id", "restored", "restorations")


@query(
    "restore_documents_sealed",
    with_(
        RICH, *accepted_sql(SKIP_UNCERTAIN, SAFE), *numbered("accepted", "doc_id", "s"),
        "first_case AS (SELECT a.doc_id, s, e, original AS ph FROM accepted a JOIN mapping m "
        "ON m.scope = a.doc_id AND m.typ = a.typ AND m.key = lower(a.t))",
        *spliced("docs", "first_case", out="restored"),
        select="SELECT doc_id, restored FROM spliced",
    ),
)
def restore_documents_sealed(spark, sf_dir):
    """Restore from a sealed mapping; only joined rows are decrypted."""
    keyring = Keyring.from_key(spark, TEST_KEY)
    run = redact_units(whole_units(rich_documents(spark, sf_dir)), document_scopes=True)
    sealed = seal(run.mapping, keyring)
    restored = restore_units(_as_units(run.texts, "redacted"), sealed, keyring=keyring)
    return restored.select("doc_id", "restored")


# an answer that names placeholders in another order, a longer one, an unknown one
_ANSWER = """concat(text, ' Ask @user1, @user10 and person1@example.com again; page ',
  'https://example.com/page1 or https://example.com/page12, not XXX-XX-0001.')"""


_ANSWERS_SQL = f"answers AS (SELECT doc_id, {_ANSWER} AS text FROM documents)"


def _plain_answers(spark, sf_dir):
    from .inputs import documents

    return whole_units(documents(spark, sf_dir).withColumn("text", F.expr(_ANSWER)))


def _find_sql() -> list[str]:
    """Placeholder mentions of the answer tail, looked up per document."""
    from .oracle_parts import hits

    return [
        hits(
            "found", "answers",
            "https://example\\.com/page[0-9]+|person[0-9]+@example\\.com|@user[0-9]+"
            "|XXX-XX-[0-9]{4,}",
        ),
        "edits AS (SELECT f.doc_id, s, e, original AS ph FROM found f JOIN mapping m "
        "ON m.scope = f.doc_id AND m.ph = f.t)",
    ]


@query(
    "restore_answers",
    with_(
        RICH, *accepted_sql(SKIP_UNCERTAIN, SAFE), *numbered("accepted", "doc_id", "s"),
        _ANSWERS_SQL, *_find_sql(), *spliced("answers", "edits", out="restored"),
        select="""SELECT doc_id, restored, coalesce(n, 0) AS restorations FROM spliced
          LEFT JOIN (SELECT doc_id, count(*) AS n FROM edits GROUP BY doc_id) USING (doc_id)""",
    ),
)
def restore_answers(spark, sf_dir):
    """Texts that were never redacted but name placeholders of their scope."""
    restored = restore_units(_plain_answers(spark, sf_dir), _doc_mapping(spark, sf_dir))
    return restored.select("doc_id", "restored", "restorations")


# custom placeholders of the document, beside and inside generated ones
_CUSTOM_ANSWER = """concat(text, ' <email> and <email>1, <phone>; <ssn', '> @user1<url>')"""


@query(
    "restore_custom_placeholders",
    with_(
        *_SHARED,
        f"answers AS (SELECT doc_id, {_CUSTOM_ANSWER} AS text FROM documents)",
        "last AS (SELECT scope, '<' || typ || '>' AS ph, arg_max(original, ord) AS original "
        "FROM vals GROUP BY scope, typ)",
        """words AS (SELECT doc_id, unnest(string_split(text, '<')) AS w,
             generate_subscripts(string_split(text, '<'), 1) AS i FROM answers)""",
        """parts AS (SELECT doc_id, i, CASE WHEN i = 1 THEN w
               WHEN l.ph IS NULL THEN '<' || w
               ELSE l.original || substr(w, instr(w, '>') + 1) END AS part,
             CAST(l.ph IS NOT NULL AS BIGINT) AS hit
             FROM words LEFT JOIN last l ON l.scope = doc_id AND i > 1
               AND l.ph = '<' || substr(w, 1, CAST(instr(w, '>') AS BIGINT)))""",
        select="SELECT doc_id, string_agg(part, '' ORDER BY i) AS restored, "
        "CAST(sum(hit) AS BIGINT) AS restorations FROM parts GROUP BY doc_id",
    ),
)
def restore_custom_placeholders(spark, sf_dir):
    """Placeholders that no template gives are found through the mapping."""
    from .inputs import documents

    texts = documents(spark, sf_dir).withColumn("text", F.expr(_CUSTOM_ANSWER))
    restored = restore_units(whole_units(texts), _shared_mapping(spark, sf_dir))
    return restored.select("doc_id", "restored", "restorations")


def _sequential_sql() -> list[str]:
    """One replacement per step, in the order in which the values were mapped."""
    return [
        """pairs AS (SELECT scope AS doc_id, ph, original,
             row_number() OVER (PARTITION BY scope ORDER BY ord, typ, n) AS k FROM mapping)""",
        """steps AS (
             SELECT doc_id, CAST(0 AS BIGINT) AS k, text AS out, CAST(0 AS BIGINT) AS hits FROM answers
             UNION ALL
             SELECT s.doc_id, p.k, replace(s.out, p.ph, p.original),
               s.hits + CAST((length(s.out) - length(replace(s.out, p.ph, ''))) // length(p.ph) AS BIGINT)
             FROM steps s JOIN pairs p ON p.doc_id = s.doc_id AND p.k = s.k + 1)""",
    ]


@query(
    "restore_answers_sequential",
    with_(
        RICH, *accepted_sql(SKIP_UNCERTAIN, SAFE), *numbered("accepted", "doc_id", "s"),
        _ANSWERS_SQL, *_sequential_sql(),
        select="SELECT doc_id, arg_max(out, k) AS restored, arg_max(hits, k) AS restorations "
        "FROM steps GROUP BY doc_id",
    ),
)
def restore_answers_sequential(spark, sf_dir):
    """The compatibility mode: ``@user1`` also changes ``@user10``."""
    units = whole_units(rich_documents(spark, sf_dir))
    spans = stage(decide(unit_spans(units), SKIP_UNCERTAIN), "spans")
    restored = restore_units_sequential(
        _plain_answers(spark, sf_dir), assign_placeholders(spans, document_scopes=True)
    )
    return restored.select("doc_id", "restored", "restorations")


@query(
    "restore_unknown_scopes",
    with_(
        source("docs", "text"), *raw("docs"), CLAIMS,
        *greedy("resolved", "claims", "longest", False),
        select="""SELECT doc_id, 'no mappings available for restoration' AS error FROM documents
          WHERE doc_id NOT IN (SELECT doc_id FROM resolved WHERE status = 'match')""",
    ),
)
def restore_unknown_scopes(spark, sf_dir):
    """Documents without any mapping give an error row."""
    from .inputs import documents

    docs = documents(spark, sf_dir)
    mapping = row_mapping(redact_rows(docs), ["doc_id"]).withColumnRenamed(
        "doc_id", "scope_id"
    )
    _, unknown = split_unknown_scopes(whole_units(docs), mapping)
    return unknown.select("doc_id", "error")


# -- sessions ---------------------------------------------------------------------------------

_SESSION_RUN = [
    _TURNS, *accepted_sql(SKIP_UNCERTAIN, SAFE),
    "spans AS (SELECT *, doc_id // 1000 AS conv, doc_id % 1000 AS turn FROM accepted)",
    *numbered("spans", "conv", "turn * 10000000 + s"),
    "edits AS (SELECT a.doc_id, s, e, ph FROM spans a JOIN mapping m "
    "ON m.scope = a.conv AND m.typ = a.typ AND m.key = lower(a.t))",
]
_QUEUE = [
    """queue AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 1000
         ORDER BY doc_id, s) - 1 AS idx FROM resolved WHERE status = 'uncertain')""",
]


def _session_units(spark, sf_dir):
    return session_units(conversations(spark, sf_dir), "conv_id", "turn")


@query(
    "redact_sessions",
    with_(
        *_SESSION_RUN, *spliced("docs", "edits"),
        select="SELECT doc_id // 1000 AS scope_id, doc_id % 1000 AS unit_no, redacted FROM spliced",
    ),
)
def redact_sessions(spark, sf_dir):
    run = start_sessions(_session_units(spark, sf_dir))
    return run.redaction.texts.select(
        "scope_id", F.col("unit_no").cast("long").alias("unit_no"), "redacted"
    )


@query(
    "review_queue",
    with_(
        *_SESSION_RUN, *_QUEUE,
        select="""SELECT doc_id // 1000 AS scope_id, idx, t AS text, typ AS pii_type,
          conf AS confidence, doc_id % 1000 AS unit_no, s AS span_start FROM queue""",
    ),
)
def queue_of_sessions(spark, sf_dir):
    queue = review_queue(stage(unit_spans(_session_units(spark, sf_dir)), "spans"))
    return queue.select(
        "scope_id", F.col("idx").cast("long").alias("idx"), "text", "pii_type", "confidence",
        F.col("unit_no").cast("long").alias("unit_no"),
        F.col("start").cast("long").alias("span_start"),
    )


# every session answers its first three uncertain spans: yes, no, skip in turn
_ANSWERED = """SELECT conv_id AS scope_id, i AS idx,
  CASE (conv_id + i) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'skip' END AS decision,
  CASE WHEN conv_id % 2 = 0 THEN 'team_name' END AS type_override
  FROM (SELECT DISTINCT conv_id FROM {turns}) CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)"""


def _session_answers(spark, sf_dir):
    sessions = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return sessions.select("conv_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("idx")).select(
        F.col("conv_id").alias("scope_id"),
        "idx",
        F.expr(
            "CASE (conv_id + idx) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'skip' END"
        ).alias("decision"),
        F.expr("CASE WHEN conv_id % 2 = 0 THEN 'team_name' END").alias("type_override"),
        F.timestamp_seconds("idx").alias("decided_at"),
    )


_ANSWERED_SQL = f"answered AS ({_ANSWERED.format(turns='conversations')})"


@query(
    "review_remaining",
    with_(
        *_SESSION_RUN, *_QUEUE, _ANSWERED_SQL,
        select="""SELECT doc_id // 1000 AS scope_id, q.idx, t AS text FROM queue q
          WHERE NOT EXISTS (SELECT 1 FROM answered a
            WHERE a.scope_id = q.doc_id // 1000 AND a.idx = q.idx)""",
    ),
)
def remaining_of_sessions(spark, sf_dir):
    run = start_sessions(_session_units(spark, sf_dir))
    after = confirm(run, _session_units(spark, sf_dir), _session_answers(spark, sf_dir))
    return after.queue.select("scope_id", F.col("idx").cast("long").alias("idx"), "text")


@query(
    "confirm_sessions",
    with_(
        *_SESSION_RUN, *_QUEUE, _ANSWERED_SQL,
        """said AS (SELECT conv, typ, t, type_override FROM (
             SELECT a.scope_id AS conv, q.typ, q.t, a.type_override, a.decision,
               row_number() OVER (PARTITION BY a.scope_id, q.typ, q.t ORDER BY a.idx DESC) AS back
             FROM queue q JOIN answered a ON a.scope_id = q.doc_id // 1000 AND a.idx = q.idx
             WHERE a.decision <> 'skip') WHERE back = 1 AND decision = 'yes')""",
        """confirmed AS (SELECT r.doc_id, r.s, r.e, r.t, coalesce(type_override, r.typ) AS typ,
             conf, layer, seq, prio, status FROM resolved r JOIN said
             ON said.conv = r.doc_id // 1000 AND said.typ = r.typ AND said.t = r.t
             WHERE status = 'uncertain'
             UNION ALL SELECT * FROM resolved WHERE status = 'match')""",
        *greedy("final", "confirmed", "longest", False, by_status=False),
        "late AS (SELECT *, doc_id // 1000 AS conv, doc_id % 1000 AS turn FROM final f "
        "WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.scope = f.doc_id // 1000 "
        "AND m.typ = f.typ AND m.key = lower(f.t)))",
        *numbered("late", "conv", "turn * 10000000 + s", name="added"),
        f"""everything AS (SELECT scope, typ, key, ph FROM mapping UNION ALL
             SELECT a.scope, a.typ, a.key, {placeholder('a.typ', '(a.n + coalesce(l.last, 0))')}
             FROM added a LEFT JOIN (SELECT scope, typ, max(n) AS last FROM mapping GROUP BY ALL) l
             ON l.scope = a.scope AND l.typ = a.typ)""",
        "late_edits AS (SELECT f.doc_id, s, e, ph FROM final f JOIN everything m "
        "ON m.scope = f.doc_id // 1000 AND m.typ = f.typ AND m.key = lower(f.t))",
        *spliced("docs", "late_edits", name="again"),
        select="SELECT doc_id // 1000 AS scope_id, doc_id % 1000 AS unit_no, redacted FROM again",
    ),
)
def confirm_sessions(spark, sf_dir):
    """Confirmed values are redacted under the chosen type; numbers go on."""
    units = _session_units(spark, sf_dir)
    run = confirm(start_sessions(units), units, _session_answers(spark, sf_dir))
    return run.redaction.texts.select(
        "scope_id", F.col("unit_no").cast("long").alias("unit_no"), "redacted"
    )


@query(
    "restore_sessions",
    with_(
        *_SESSION_RUN,
        "first_case AS (SELECT a.doc_id, s, e, original AS ph FROM spans a JOIN mapping m "
        "ON m.scope = a.conv AND m.typ = a.typ AND m.key = lower(a.t))",
        *spliced("docs", "first_case", out="restored"),
        select="SELECT doc_id // 1000 AS scope_id, doc_id % 1000 AS unit_no, restored FROM spliced",
    ),
)
def restore_sessions(spark, sf_dir):
    run = start_sessions(_session_units(spark, sf_dir)).redaction
    restored = restore_units(_as_units(run.texts, "redacted"), run.mapping)
    return restored.select(
        "scope_id", F.col("unit_no").cast("long").alias("unit_no"), "restored"
    )


# Even turns arrive first, then the odd ones, which in every fifth session come
# two hours later, when the session has ended and is opened anew.
_STREAM = [
    _TURNS, *accepted_sql(SKIP_UNCERTAIN, SAFE),
    """opens AS (SELECT conv_id AS conv, min(turn) FILTER (turn % 2 = 0) AS even,
         min(turn) FILTER (turn % 2 = 1) AS odd FROM conversations GROUP BY conv_id)""",
    """keyed AS (SELECT doc_id, conv || '/' || (1700000000 + CASE
           WHEN even IS NULL OR doc_id % 2 = 0 OR conv % 5 > 0 THEN coalesce(even, odd + late)
           ELSE odd + late END) AS scope
         FROM (SELECT *, CASE WHEN conv % 5 = 0 THEN 7200 ELSE 0 END AS late
               FROM docs JOIN opens ON conv = doc_id // 1000))""",
    "spans AS (SELECT * FROM accepted JOIN keyed USING (doc_id))",
    *numbered(
        "spans", "scope", "(doc_id % 2) * 1000000000000000 + (doc_id % 1000) * 10000000 + s"
    ),
    "edits AS (SELECT a.doc_id, s, e, ph FROM spans a JOIN mapping m "
    "ON m.scope = a.scope AND m.typ = a.typ AND m.key = lower(a.t))",
    *spliced("docs", "edits"),
]


@query(
    "stream_sessions",
    with_(
        *_STREAM,
        select="SELECT scope AS scope_id, doc_id % 1000 AS unit_no, redacted "
        "FROM spliced JOIN keyed USING (doc_id)",
    ),
)
def stream_sessions(spark, sf_dir):
    """Session texts as a stream of two runs over one progress log; the second
    continues the mapping of the first."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    late = "if(conv_id % 5 = 0 AND turn % 2 = 1, 7200, 0)"
    texts = conversations(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.expr(f"timestamp_seconds(1700000000 + turn + {late})").alias("ts"),
        F.col("turn").cast("int").alias("unit_no"),
        "text",
    )
    for turn in (0, 1):
        texts.where(F.col("unit_no") % 2 == turn).write.mode("append").parquet(f"{root}/in")
        arriving = spark.readStream.schema(texts.schema).parquet(f"{root}/in")
        stream = redact_stream(
            arriving, f"{root}/mapping", f"{root}/out", f"{root}/progress",
            Keyring.from_key(spark, TEST_KEY), availableNow=True,
        )
        stream.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        "scope_id", F.col("unit_no").cast("long").alias("unit_no"), "redacted"
    )
