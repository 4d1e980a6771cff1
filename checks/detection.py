"""Detection layers, arbitration and scan reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakspan import rules as R
from cloakspan.operators.detect import (
    SPAN_FIELDS,
    Detector,
    contextual_spans,
    detect_spans,
    name_spans,
    raw_spans,
    rule_spans,
)
from cloakspan.functions.spans import context_of
from cloakspan.operators.dictionary import dictionary_spans
from cloakspan.operators.entities import with_entities
from cloakspan.operators.learning import pattern_rules
from cloakspan.operators.patterns import pattern_spans
from cloakspan.operators.redact import ACCEPT_ALL, Policy, table_spans, unit_spans
from cloakspan.operators.report import leftovers, scan_counts, scan_summary
from cloakspan.sources.units import whole_units

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
from .oracle_parts import (
    CLAIMS,
    MASKED,
    greedy,
    hits,
    name_confidence,
    name_hits,
    q,
    raw,
    rule_hits,
    source,
    span_rows,
    with_,
)
from .registry import SPAN_SQL, query, span_columns

RICH = source("docs", sql_text(RICH_TEXT))
SCORED = SPAN_SQL + ", conf AS confidence, status"


def exploded(docs, spans: str):
    """Span rows of a document table for a span expression over ``body``."""
    body = docs.withColumnRenamed("text", "body")
    return body.select("doc_id", "body", F.expr(f"inline({spans})").alias(*SPAN_FIELDS))


def scored(df, key: str = "doc_id"):
    return span_columns(df, "confidence", "status", key=key)


def _register_rule(rule: R.Rule) -> None:
    sql = with_(
        RICH,
        rule_hits("h", "docs", rule),
        select=f"SELECT doc_id, s AS span_start, e AS span_end, t AS text, "
        f"{q(rule.pii_type)} AS pii_type, CAST({rule.confidence} AS DOUBLE) AS confidence, "
        f"'match' AS status FROM h",
    )

    @query(f"detect_{rule.name}", sql)
    def detect_rule(spark, sf_dir):
        spans = rule_spans("body", rule, R.AUTO_THRESHOLD)
        return scored(exploded(rich_documents(spark, sf_dir), spans))


for _rule in R.REGEX_RULES:
    _register_rule(_rule)


@query(
    "detect_urls_of_pages",
    with_(
        "docs AS (SELECT page_id AS doc_id, url || ' ' || html AS text FROM pages)",
        rule_hits("h", "docs", R.RULES_BY_NAME["url"]),
        select="SELECT doc_id AS page_id, s AS span_start, e AS span_end, t AS text FROM h",
    ),
)
def urls_of_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id").select(
        F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text")
    )
    spans = rule_spans("body", R.RULES_BY_NAME["url"], R.AUTO_THRESHOLD)
    found = span_columns(exploded(pages, spans)).drop("pii_type")
    return found.withColumnRenamed("doc_id", "page_id")


@query(
    "span_context",
    with_(
        RICH,
        *raw("docs"),
        select="""SELECT doc_id, s AS span_start, e AS span_end, typ AS pii_type,
          CASE WHEN s > 50 THEN '...' ELSE '' END
          || substr(text, CAST(greatest(s - 50, 0) + 1 AS BIGINT),
                    CAST(least(e + 50, length(text)) - greatest(s - 50, 0) AS BIGINT))
          || CASE WHEN e + 50 < length(text) THEN '...' ELSE '' END AS context
          FROM raw JOIN docs USING (doc_id)""",
    ),
)
def context_of_spans(spark, sf_dir):
    spans = exploded(rich_documents(spark, sf_dir), raw_spans("body", Detector()))
    with_context = spans.withColumn("context", F.expr(context_of("body", "start", "end")))
    return span_columns(with_context, "context").drop("text")


# -- learned values ----------------------------------------------------------------

_LEARNED = (("project_name", "WIKI"), ("person_name", "mary."), ("nickname", "Baker"))


def _learned_hits() -> list[str]:
    out = []
    for i, (_, value) in enumerate(_LEARNED):
        out.append(hits(f"l{i}", "docs", "(?i)" + value.replace(".", "\\.")))
    return out


_LEARNED_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, s, e, t, {q(kind if kind in R.TYPE_PRIORITY else 'custom')} AS typ FROM l{i}"
    for i, (kind, _) in enumerate(_LEARNED)
)


@query(
    "learned_literals",
    with_(RICH, *_learned_hits(), select=f"SELECT {SPAN_SQL} FROM ({_LEARNED_ROWS})"),
)
def learned_literals(spark, sf_dir):
    """A small learned dictionary, searched inside the row."""
    detector = Detector(rules=(), names=False).with_learned(pii=_LEARNED)
    return span_columns(
        exploded(rich_documents(spark, sf_dir), raw_spans("body", detector))
    )


_ACCOUNTS = source("docs", sql_text(ACCOUNT_TEXT))


def _account_hits(boundary: str = "") -> str:
    """Every dictionary value that starts at an account mention."""
    return f"""SELECT doc_id, s AS span_start, e AS span_end, t AS text,
      'company_name' AS pii_type FROM found
      JOIN (SELECT DISTINCT lower(c_name) AS v FROM customer) ON v = lower(t) {boundary}"""


@query(
    "learned_dictionary",
    with_(
        _ACCOUNTS,
        hits("found", "docs", "(?i)customer#[0-9]{9}"),
        select=_account_hits(),
    ),
)
def learned_dictionary(spark, sf_dir):
    """A dictionary table against all texts: substrings, case-blind."""
    units = whole_units(derived(documents(spark, sf_dir), ACCOUNT_TEXT))
    names = table(spark, sf_dir, "customer").select(
        F.lit("company_name").alias("pii_type"), F.col("c_name").alias("value")
    )
    return span_columns(dictionary_spans(units, names))


@query(
    "learned_dictionary_whole_words",
    with_(
        _ACCOUNTS,
        hits("found", "docs", "(?i)customer#[0-9]{9}"),
        select=_account_hits(
            "JOIN docs USING (doc_id) WHERE NOT regexp_matches("
            "substr(docs.text, CAST(e + 1 AS BIGINT), 1), '[A-Za-z0-9_]')"
        ).replace("t AS text", "found.t AS text"),
    ),
)
def learned_dictionary_whole_words(spark, sf_dir):
    units = whole_units(derived(documents(spark, sf_dir), ACCOUNT_TEXT))
    names = table(spark, sf_dir, "customer").select(
        F.lit("company_name").alias("pii_type"), F.col("c_name").alias("value")
    )
    return span_columns(dictionary_spans(units, names, boundary=True))


@query(
    "pattern_table",
    with_(
        _ACCOUNTS,
        hits("found", "docs", "(?:[Cc]ustomer|CUSTOMER)#[0-9]{9}"),
        select=_account_hits(
            "JOIN docs USING (doc_id) WHERE NOT regexp_matches("
            "substr(docs.text, CAST(e + 1 AS BIGINT), 1), '[A-Za-z0-9_]')"
        ).replace("t AS text", "found.t AS text"),
    ),
)
def pattern_table(spark, sf_dir):
    """One pattern for each customer: a text meets those whose literal it holds."""
    units = whole_units(derived(documents(spark, sf_dir), ACCOUNT_TEXT))
    digits = F.substring_index("c_name", "#", -1)
    patterns = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.concat(F.lit("(?:[Cc]ustomer|CUSTOMER)#"), digits, F.lit(r"\b")).alias("pattern"),
        F.lit("company_name").alias("pii_type"),
        F.lit(0.9).alias("confidence"),
        F.timestamp_seconds(F.lit(0)).alias("created_at"),
    )
    return span_columns(pattern_spans(units, patterns))


# -- safe values -------------------------------------------------------------------

_SAFE = ("Mary Baker", "10.0.7.7", "MARY.3@corp.io")


@query(
    "safe_suppression",
    with_(
        RICH,
        *raw("docs"),
        "claims AS (SELECT * FROM raw WHERE lower(t) NOT IN "
        f"({', '.join(q(v.lower()) for v in _SAFE)}))",
        select=f"SELECT {SCORED} FROM claims",
    ),
)
def safe_suppression(spark, sf_dir):
    detector = Detector().with_learned(safe=_SAFE)
    return scored(exploded(rich_documents(spark, sf_dir), raw_spans("body", detector)))


_SAFE_TABLE_SQL = (
    "SELECT DISTINCT 'mary.' || cast(doc_id % 50 AS varchar) || '@corp.io' AS v "
    "FROM labels WHERE toxic = 1"
)


@query(
    "safe_and_dictionary_tables",
    with_(
        _ACCOUNTS,
        f"safe AS ({_SAFE_TABLE_SQL} UNION SELECT 'mary baker' UNION SELECT lower(c_name) FROM customer)",
        hits("found", "docs", "(?i)customer#[0-9]{9}"),
        *raw(
            "docs",
            extra=[
                "SELECT doc_id, s, e, t, 'company_name', 1.0, 1, 0, 6, 'match' FROM found "
                "JOIN (SELECT DISTINCT lower(c_name) AS v FROM customer) ON v = lower(t)"
            ],
        ),
        "kept AS (SELECT * FROM raw WHERE layer = 1 OR lower(t) NOT IN (SELECT v FROM safe))",
        CLAIMS.replace("FROM raw", "FROM kept"),
        *greedy("resolved", "claims", "longest", same_text=False),
        select=f"SELECT {SCORED} FROM resolved",
    ),
)
def safe_and_dictionary_tables(spark, sf_dir):
    """Dictionary and safe list as tables: union, anti-join, arbitration."""
    units = whole_units(derived(documents(spark, sf_dir), ACCOUNT_TEXT))
    names = table(spark, sf_dir, "customer").select(
        F.lit("company_name").alias("pii_type"), F.col("c_name").alias("value")
    )
    labels = table(spark, sf_dir, "labels")
    safe = (
        labels.where("toxic = 1")
        .select(F.expr("concat('mary.', cast(doc_id % 50 AS string), '@corp.io') AS value_lc"))
        .union(names.select(F.lower("value")))
        .union(labels.select(F.lit("mary baker")))
    )
    return scored(table_spans(units, Detector(), names, safe))


# -- custom patterns ------------------------------------------------------------------

_CUSTOM = (
    ("handle_tail", r"dev_[0-9]", "team_name", 0.90),
    ("past_tense", r"[A-Z][a-z]+ed\b", "mood", 0.60),
    ("host", r"corp\.io", "project_name", 0.75),
    ("phone_again", r"\+1 [0-9]{3}-[0-9]{3}-[0-9]{4}", "custom", 0.99),
)


def _custom_table(spark, sf_dir):
    """The patterns as a table with one row per name, as a store holds them."""
    rows = [(n, p, t, c, i) for i, (n, p, t, c) in enumerate(_CUSTOM)]
    return spark.createDataFrame(
        rows, "name string, pattern string, pii_type string, confidence double, at int"
    ).select(
        "name", "pattern", "pii_type", "confidence",
        F.timestamp_seconds("at").alias("created_at"),
    )


def _custom_ctes() -> tuple[list[str], list[str]]:
    ctes, rows = [], []
    for i, (_, pattern, kind, conf) in enumerate(_CUSTOM):
        kind = kind if kind in R.TYPE_PRIORITY else "custom"
        ctes.append(hits(f"c{i}", "docs", pattern, on=MASKED))
        status = "match" if conf >= R.AUTO_THRESHOLD else "uncertain"
        rows.append(span_rows(f"c{i}", kind, str(conf), 3, i, status))
    return ctes, rows


_CUSTOM_CTES, _CUSTOM_ROWS = _custom_ctes()


@query(
    "custom_patterns",
    with_(
        RICH, *_CUSTOM_CTES,
        select=f"SELECT {SCORED} FROM ({' UNION ALL '.join(_CUSTOM_ROWS)})",
    ),
)
def custom_patterns(spark, sf_dir):
    detector = Detector(
        rules=(), names=False, custom_patterns=pattern_rules(_custom_table(spark, sf_dir))
    )
    return scored(exploded(rich_documents(spark, sf_dir), raw_spans("body", detector)))


# -- names and keywords ------------------------------------------------------------------


@query(
    "name_bigrams",
    with_(
        RICH,
        name_hits("h", "docs"),
        select=f"SELECT doc_id, s AS span_start, e AS span_end, t AS text, "
        f"'person_name' AS pii_type, CAST({name_confidence('t')} AS DOUBLE) AS confidence, "
        f"'uncertain' AS status FROM h",
    ),
)
def name_bigrams(spark, sf_dir):
    return scored(exploded(rich_documents(spark, sf_dir), name_spans("body")))


def _contextual_ctes() -> list[str]:
    return [
        hits(
            f"k{i}", "docs", "(?i)" + R.contextual_pattern(kind).replace("*+", "*"),
            on=MASKED, group=2,
        )
        for i, kind in enumerate(R.CONTEXT_KEYWORDS)
    ]


@query(
    "contextual_candidates",
    with_(
        RICH,
        *_contextual_ctes(),
        select=" UNION ALL ".join(
            f"SELECT doc_id, s AS span_start, e AS span_end, t AS text, "
            f"{q(kind)} AS pii_type, CAST(0.6 AS DOUBLE) AS confidence, "
            f"'uncertain' AS status FROM k{i}"
            for i, kind in enumerate(R.CONTEXT_KEYWORDS)
        ),
    ),
)
def contextual_candidates(spark, sf_dir):
    docs = rich_documents(spark, sf_dir)
    parts = [contextual_spans("body", kind) for kind in R.CONTEXT_KEYWORDS]
    return scored(exploded(docs, f"concat({', '.join(parts)})"))


# -- entities ----------------------------------------------------------------------------

# (label, the piece of ENTITY_TEXT it covers); the SQL states the cleaned form.
_ENTITIES = (
    ("PERSON", "concat('Anna Maria Lopez', cast(doc_id % 9 as {string}), ' - sales')"),
    ("ORG", "concat('Project Falcon', cast(doc_id % 5 as {string}), ' Inc')"),
    ("ORG", "concat('Client Meetings', cast(doc_id % 5 as {string}))"),
    ("GPE", "'Berlin'"),
    ("ORG", "'Team'"),
    ("ORG", "concat('10.1.2.', cast(doc_id % 200 as {string}))"),
    ("ORG", "concat('Acme', cast(doc_id % 11 as {string}), chr(10), 'Ltd')"),
    ("DATE", "' 4 May'"),
    ("PRODUCT", "concat('a', cast(doc_id % 13 as {string}), '@corp.io')"),
    ("MONEY", "'Talk'"),
)


def _entity_rows(spark, sf_dir):
    docs = derived(documents(spark, sf_dir), ENTITY_TEXT)
    pieces = ", ".join(
        f"struct('{label}' AS label, {piece.format(string='string')} AS piece)"
        for label, piece in _ENTITIES
    )
    found = docs.select("doc_id", "text", F.expr(f"inline(array({pieces}))"))
    at = F.expr("locate(piece, text) - 1")
    return found.select(
        "doc_id", F.lit(0).alias("unit_no"), "label", at.alias("start"),
        (at + F.length("piece")).alias("end"),
    )


def _entity_sql() -> str:
    cleaned = {
        0: ("'Anna Maria Lopez'", "person_name", 0.90),
        1: (_ENTITIES[1][1].replace("'Project Falcon'", "'Falcon'"), "company_name", 0.85),
        3: ("'Berlin'", "address", 0.60),
        6: ("concat('Acme', cast(doc_id % 11 as {string}))", "company_name", 0.85),
        7: ("'4 May'", "date_of_birth", 0.50),
    }
    rows = []
    for i, (text, kind, conf) in cleaned.items():
        text = text.format(string="varchar")
        piece = _ENTITIES[i][1].format(string="varchar")
        status = "match" if conf >= R.AUTO_THRESHOLD else "uncertain"
        rows.append(
            f"SELECT doc_id, {text} AS t, '{kind}' AS typ, CAST({conf} AS DOUBLE) AS conf, "
            f"'{status}' AS status, instr(text, {piece}) AS at0, text FROM docs"
        )
    union = " UNION ALL ".join(rows)
    anchored = (
        "SELECT doc_id, at0 - 1 + instr(substr(text, CAST(at0 AS BIGINT)), t) - 1 AS s, "
        f"t, typ, conf, status FROM ({union})"
    )
    return (
        "SELECT doc_id, CAST(s AS BIGINT) AS span_start, CAST(s + length(t) AS BIGINT) AS span_end, "
        f"t AS text, typ AS pii_type, conf AS confidence, status FROM ({anchored})"
    )


@query(
    "entity_intake",
    with_(source("docs", sql_text(ENTITY_TEXT)), select=_entity_sql()),
)
def entity_intake(spark, sf_dir):
    """Entities of a model: labels, stop words, clean-up, anchoring.  The one on
    the e-mail address is dropped because the rule layer claimed its span."""
    units = whole_units(derived(documents(spark, sf_dir), ENTITY_TEXT))
    entities = _entity_rows(spark, sf_dir)
    attached = with_entities(units, entities, ["doc_id", "unit_no"])
    spans = raw_spans("body", Detector(names=False), "entities")
    body = attached.withColumnRenamed("text", "body")
    rows = body.select("doc_id", F.expr(f"inline({spans})").alias(*SPAN_FIELDS))
    return scored(rows.where(F.col("layer") == R.LAYER_ENTITY))


# -- arbitration ----------------------------------------------------------------------------


@query(
    "first_claims",
    with_(
        RICH, *_CUSTOM_CTES, *raw("docs", extra=_CUSTOM_ROWS), CLAIMS,
        select=f"SELECT {SCORED} FROM claims",
    ),
)
def first_claims_of_spans(spark, sf_dir):
    """A custom pattern on a phone's exact span loses to the phone rule."""
    detector = Detector(custom_patterns=pattern_rules(_custom_table(spark, sf_dir)))
    return scored(exploded(rich_documents(spark, sf_dir), detect_spans("body", detector)))


def _arbitrated(policy: Policy, same_text: bool) -> str:
    return with_(
        RICH, *_CUSTOM_CTES, *raw("docs", extra=_CUSTOM_ROWS), CLAIMS,
        *greedy("resolved", "claims", policy.order, same_text),
        select=f"SELECT {SCORED} FROM resolved",
    )


def _arbitrated_spans(spark, sf_dir, policy):
    detector = Detector(custom_patterns=pattern_rules(_custom_table(spark, sf_dir)))
    units = whole_units(rich_documents(spark, sf_dir))
    return scored(unit_spans(units, detector, policy))


@query("arbitrate_longest", _arbitrated(Policy(), same_text=False))
def arbitrate_longest(spark, sf_dir):
    return _arbitrated_spans(spark, sf_dir, Policy())


@query("arbitrate_reference", _arbitrated(Policy.reference(), same_text=True))
def arbitrate_reference(spark, sf_dir):
    return _arbitrated_spans(spark, sf_dir, Policy.reference())


@query("arbitrate_reference_all_repeats", _arbitrated(Policy.reference(), same_text=False))
def arbitrate_reference_all_repeats(spark, sf_dir):
    return _arbitrated_spans(spark, sf_dir, Policy("reference", "all"))


PLAIN = [
    source("docs", "text"), *raw("docs"), CLAIMS,
    *greedy("resolved", "claims", "reference", same_text=True),
]


@query(
    "scan_documents",
    with_(*PLAIN, select=f"SELECT {SCORED} FROM resolved"),
)
def scan_documents(spark, sf_dir):
    """A scan of the plain documents under the reference policy."""
    return scored(unit_spans(whole_units(documents(spark, sf_dir)), policy=Policy.reference()))


@query(
    "scan_counts",
    with_(
        *PLAIN,
        select="SELECT doc_id, status, typ AS pii_type, count(*) AS spans FROM resolved "
        "GROUP BY ROLLUP (doc_id, status, typ)",
    ),
)
def scan_counts_of_documents(spark, sf_dir):
    return scan_counts(
        unit_spans(whole_units(documents(spark, sf_dir)), policy=Policy.reference())
    )


@query(
    "scan_summary",
    with_(
        *PLAIN,
        select="SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'match') AS high, "
        "count(*) FILTER (status = 'uncertain') AS uncertain FROM resolved GROUP BY doc_id",
    ),
)
def scan_summary_of_documents(spark, sf_dir):
    return scan_summary(
        unit_spans(whole_units(documents(spark, sf_dir)), policy=Policy.reference())
    )


@query(
    "leftovers",
    with_(
        RICH, *raw("docs", names=False), CLAIMS,
        *greedy("resolved", "claims", "reference", same_text=True),
        select="""SELECT c.doc_id, c.s AS span_start, c.e AS span_end, c.t AS text,
          c.typ AS pii_type FROM claims c WHERE NOT EXISTS (SELECT 1 FROM resolved r
          WHERE r.doc_id = c.doc_id AND r.s <= c.s AND r.e >= c.e)""",
    ),
)
def leftovers_of_reference(spark, sf_dir):
    """What the compatibility mode leaves partly visible."""
    units = whole_units(rich_documents(spark, sf_dir))
    detector = Detector(names=False)
    claims = units.withColumnRenamed("text", "body").select(
        "scope_id", "doc_id", "unit_no",
        F.expr(f"inline({detect_spans('body', detector)})").alias(*SPAN_FIELDS),
    )
    chosen = unit_spans(units, detector, Policy.reference(), ACCEPT_ALL)
    return span_columns(leftovers(claims, chosen))
