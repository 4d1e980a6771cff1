"""Sources, units and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cloakspan import rules as R
from cloakspan.functions.staging import shared_folder
from cloakspan.operators.detect import Detector
from cloakspan.plans.sessions import session_units
from cloakspan.sources.files import (
    read_text_files,
    redacted_name,
    restored_name,
    route_files,
    write_texts,
)
from cloakspan.sources.large_files import file_spans, read_file_units
from cloakspan.sources.tables import cell_units
from cloakspan.sources.units import (
    join_pages,
    join_sheets,
    join_slides,
    join_units,
    split_units,
)

from .inputs import RICH_TEXT, SESSION_TEXT, conversations, documents, rich_documents, sql_text, table
from .oracle_parts import CLAIMS, q, rule_hits, span_rows, with_
from .registry import query


@query("text_files", "SELECT item_id, text FROM benchmark")
def text_files(spark, sf_dir):
    """Write a table as text files, one folder per item, and read them whole."""
    items = table(spark, sf_dir, "benchmark", "item_id")
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    write_texts(items, path, "text", F.col("item_id").cast("string"), "text")
    read = read_text_files(spark, path)
    item = F.regexp_extract("doc_id", r"output_name=(\d+)", 1).cast("long")
    # the text sink ends every file with a line end
    return read.select(
        item.alias("item_id"), F.regexp_replace("text", r"\n\z", "").alias("text")
    )


_FILE_RULES = tuple(R.RULES_BY_NAME[name] for name in ("email", "phone", "credit_card"))


@query(
    "detect_large_files",
    with_(
        f"""files AS (
  SELECT coalesce(lang, 'none') AS doc_id,
         regexp_replace(string_agg({sql_text(RICH_TEXT)}, chr(10) ORDER BY doc_id),
                        '\r\n?', chr(10), 'g') AS text
  FROM documents GROUP BY 1)""",
        *(rule_hits(f"h_{r.name}", "files", r) for r in _FILE_RULES),
        "raw AS ("
        + " UNION ALL ".join(
            span_rows(f"h_{r.name}", r.pii_type, str(r.confidence), 2, r.seq, "match")
            for r in _FILE_RULES
        )
        + ")",
        CLAIMS,
        select="SELECT doc_id AS lang, s AS span_start, e AS span_end, t AS text, typ AS pii_type "
        "FROM claims",
    ),
)
def detect_large_files(spark, sf_dir):
    """Write the documents of each language as one text, in part files that follow one
    another, so no task writes a whole language; spans of these texts."""
    docs = rich_documents(spark, sf_dir)
    path = f"{shared_folder(spark)}/large-{uuid.uuid4().hex}"
    (
        docs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "text")
        .repartitionByRange("lang", "doc_id")
        .sortWithinPartitions("lang", "doc_id")
        .select("lang", "text")
        .write.partitionBy("lang")
        .text(path)
    )
    units = read_file_units(spark, path, folders=True)
    spans = file_spans(units, Detector(rules=_FILE_RULES, names=False))
    return spans.select(
        F.regexp_extract("doc_id", "lang=([^/]*)", 1).alias("lang"),
        F.col("start").cast("long").alias("span_start"),
        F.col("end").cast("long").alias("span_end"),
        "text",
        "pii_type",
    )


_SUFFIXES = [
    ".txt", ".MD", ".markdown", ".text", ".docx", ".pdf", ".xlsx", ".xlsm", ".pptx",
    ".csv", "", "_redacted.txt",
]
_PATH = (
    "concat('/in.dir/', source, '/doc', cast(doc_id as {string}), "
    + "CASE doc_id % 12 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUFFIXES))
    + " END)"
)
_EXT_SQL = (
    "lower(regexp_extract(regexp_replace(regexp_extract(path, '([^/]*)$', 1), "
    "'^\\.+', ''), '(\\.[^.]*)$', 1))"
)
_FAMILY_SQL = (
    "CASE extension "
    + " ".join(f"WHEN {q(e)} THEN {q(f)}" for e, f in R.EXTENSION_FAMILY.items())
    + " END"
)


@query(
    "route_files",
    f"""WITH p AS (SELECT doc_id, {_PATH.format(string='varchar')} AS path FROM documents),
    x AS (SELECT doc_id, path, {_EXT_SQL} AS extension FROM p),
    f AS (SELECT *, {_FAMILY_SQL} AS family FROM x)
    SELECT doc_id, path, extension, family,
      CASE WHEN family IS NULL THEN concat('unsupported file type: ', extension) END AS error
    FROM f""",
)
def routed_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_PATH.format(string="string")).alias("path")
    )
    return route_files(docs)


@query(
    "output_names",
    f"""WITH p AS (SELECT doc_id, {_PATH.format(string='varchar')} AS path FROM documents),
    x AS (SELECT doc_id, path, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM p),
    y AS (SELECT *, path[1:length(path) - length(ext)] AS base FROM x)
    SELECT doc_id, path, base || '_redacted' || ext AS redacted_name,
      regexp_replace(base, '_redacted$', '') || '_restored' || ext AS restored_name FROM y""",
)
def output_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_PATH.format(string="string")).alias("path")
    )
    return docs.select(
        "doc_id", "path",
        redacted_name(F.col("path")).alias("redacted_name"),
        restored_name(F.col("path")).alias("restored_name"),
    )


@query(
    "split_units",
    """SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT)
       AS unit_no, unnest(string_split(text, chr(10))) AS text FROM documents""",
)
def units_of_documents(spark, sf_dir):
    units = split_units(documents(spark, sf_dir))
    return units.select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), "text")


@query("join_units", "SELECT doc_id, text FROM documents")
def joined_units(spark, sf_dir):
    return join_units(split_units(documents(spark, sf_dir)))


@query(
    "join_pages",
    f"""SELECT conv_id AS doc_id, string_agg(text,
        {q(R.PAGE_SEPARATOR).replace(chr(10), "'||chr(10)||'")} ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
)
def joined_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn")
    return join_pages(
        turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_no"), "text")
    )


@query(
    "join_sheets",
    """WITH lines AS (
      SELECT c_nationkey AS doc_id, ascii(c_mktsegment) AS a, c_custkey AS b,
        concat_ws(chr(9), c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL
                  ELSE cast(c_nationkey AS varchar) END) AS line FROM customer
      UNION ALL
      SELECT DISTINCT c_nationkey, ascii(c_mktsegment), -1,
        '--- Sheet: ' || c_mktsegment || ' ---' FROM customer)
    SELECT CAST(doc_id AS BIGINT) AS doc_id, string_agg(line, chr(10) ORDER BY a, b) AS text
    FROM lines GROUP BY doc_id""",
)
def joined_sheets(spark, sf_dir):
    customer = table(spark, sf_dir, "customer", "c_custkey")
    cells = customer.select(
        F.col("c_nationkey").cast("long").alias("doc_id"),
        F.ascii("c_mktsegment").alias("sheet_no"),
        F.col("c_mktsegment").alias("sheet"),
        F.col("c_custkey").alias("row_no"),
        F.expr(
            "inline(array(struct(1 AS col_no, c_name AS value), struct(2 AS col_no, "
            "if(c_custkey % 7 = 0, NULL, cast(c_nationkey AS string)) AS value)))"
        ),
    )
    return join_sheets(cells)


@query(
    "join_slides",
    """WITH lines AS (
      SELECT conv_id AS doc_id, turn // 2 AS a,
        CASE WHEN role = 'system' THEN 2147483648 ELSE turn END AS b,
        CASE WHEN role = 'system' THEN '[Notes] ' ELSE '' END || text AS line
      FROM conversations WHERE trim(text) <> ''
      UNION ALL
      SELECT DISTINCT conv_id, turn // 2, -1,
        '--- Slide ' || cast(turn // 2 AS varchar) || ' ---' FROM conversations)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY a, b, line) AS text
    FROM lines GROUP BY doc_id""",
)
def joined_slides(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn")
    return join_slides(
        turns.select(
            F.col("conv_id").alias("doc_id"),
            F.expr("turn div 2").alias("slide_no"),
            F.col("turn").alias("shape_no"),
            F.when(F.col("role") == "system", "notes").otherwise("shape").alias("kind"),
            "text",
        )
    )


@query(
    "table_cells",
    """SELECT page_id, 'url' AS part, CAST(0 AS BIGINT) AS unit_no, url AS text FROM pages
       WHERE regexp_matches(url, '\\S')
       UNION ALL SELECT page_id, 'html', 1, html FROM pages WHERE regexp_matches(html, '\\S')""",
)
def cells_of_pages(spark, sf_dir):
    cells = cell_units(table(spark, sf_dir, "pages", "page_id"), "page_id")
    return cells.select(
        F.col("doc_id").alias("page_id"), "part",
        F.col("unit_no").cast("long").alias("unit_no"), "text",
    )


@query(
    "session_texts",
    f"""SELECT conv_id AS scope_id, 'message' AS part, turn AS unit_no,
        {sql_text(SESSION_TEXT)} AS text FROM conversations""",
)
def texts_of_sessions(spark, sf_dir):
    units = session_units(conversations(spark, sf_dir), "conv_id", "turn")
    return units.select(
        "scope_id", "part", F.col("unit_no").cast("long").alias("unit_no"), "text"
    )
