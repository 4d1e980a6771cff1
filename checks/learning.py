"""Feedback tables: learned values, safe values, custom patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cloakspan import rules as R
from cloakspan.functions.staging import shared_folder
from cloakspan.operators.learning import (
    apply_feedback,
    clear_learned,
    clear_patterns,
    export_learned,
    import_learned,
    import_patterns,
    learned_object,
    learn_pii,
    learn_safe,
    learning_stats,
    look_up,
    read_learned,
    read_learned_object,
    remove_patterns,
    upsert_patterns,
)

from .inputs import table
from .oracle_parts import q
from .registry import query

# The store's state, read off the tables: customers are learned as companies or
# projects, suppliers are safe; the new feedback is about the other's values.
_PII = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'project_name' ELSE 'company_name' END AS pii_type,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(c_name) END AS value FROM {customer}"""
_SAFE = "SELECT lower(s_name) AS value_lc FROM {supplier}"
_NEW_PII = """SELECT 'team_name' AS pii_type,
  CASE WHEN s_nationkey < 12 THEN s_name ELSE s_name || ' & Co' END AS value FROM {supplier}"""
_NEW_SAFE = """SELECT CASE WHEN c_nationkey < 12 THEN c_name ELSE c_name || ' & Co' END AS value
  FROM {customer}"""
_DECISIONS = """SELECT 'company_name' AS pii_type, c_name AS value,
  CASE c_custkey % 4 WHEN 0 THEN 'yes' WHEN 3 THEN 'skip' ELSE 'no' END AS decision,
  CASE WHEN c_nationkey = 3 THEN 'team_name' END AS type_override,
  c_custkey AS decided_at FROM {customer}
  UNION ALL
  SELECT 'company_name', upper(c_name),
  CASE WHEN c_custkey % 5 = 0 THEN 'yes' ELSE 'no' END, NULL,
  c_custkey * 7 % 1000 FROM {customer}
  UNION ALL
  SELECT 'company_name', lower(c_name),
  CASE WHEN c_custkey % 7 = 0 THEN 'no' ELSE 'yes' END, NULL,
  c_custkey * 11 % 1300 FROM {customer}
  UNION ALL
  SELECT 'person_name', s_name, 'yes', NULL, s_suppkey FROM {supplier}"""

_HERE = {"customer": "customer", "supplier": "supplier"}


def _sql(statement: str) -> str:
    return statement.format(**_HERE)


def _frame(spark, sf_dir, statement: str):
    names = {}
    for name in _HERE:
        table(spark, sf_dir, name).createOrReplaceTempView(f"learning_{name}")
        names[name] = f"learning_{name}"
    return spark.sql(statement.format(**names))


def _state(spark, sf_dir):
    return _frame(spark, sf_dir, _PII), _frame(spark, sf_dir, _SAFE)


def _merged(pii, safe):
    """Both tables as one result."""
    return pii.select(F.lit("pii").alias("kind"), "pii_type", "value").unionByName(
        safe.select(
            F.lit("safe").alias("kind"),
            F.lit(None).cast("string").alias("pii_type"),
            F.col("value_lc").alias("value"),
        )
    )


def _both(pii: str, safe: str) -> str:
    return (
        f"SELECT 'pii' AS kind, pii_type, value FROM ({pii}) UNION ALL "
        f"SELECT 'safe', NULL, value_lc FROM ({safe})"
    )


@query(
    "learn_pii",
    _both(
        f"{_sql(_PII)} UNION {_sql(_NEW_PII)}",
        f"SELECT value_lc FROM ({_sql(_SAFE)}) WHERE value_lc NOT IN "
        f"(SELECT lower(value) FROM ({_sql(_NEW_PII)}))",
    ),
)
def learned_pii(spark, sf_dir):
    pii, safe = _state(spark, sf_dir)
    return _merged(*learn_pii(pii, safe, _frame(spark, sf_dir, _NEW_PII)))


@query(
    "learn_safe",
    _both(
        f"SELECT * FROM ({_sql(_PII)}) WHERE value NOT IN (SELECT value FROM ({_sql(_NEW_SAFE)})) "
        f"AND value NOT IN (SELECT lower(value) FROM ({_sql(_NEW_SAFE)}))",
        f"{_sql(_SAFE)} UNION SELECT lower(value) FROM ({_sql(_NEW_SAFE)})",
    ),
)
def learned_safe(spark, sf_dir):
    pii, safe = _state(spark, sf_dir)
    return _merged(*learn_safe(pii, safe, _frame(spark, sf_dir, _NEW_SAFE)))


_EVENTS = f"""WITH said AS ({_sql(_DECISIONS)}),
  added AS (SELECT coalesce(type_override, pii_type) AS pii_type, value, decided_at AS at0
            FROM said WHERE decision = 'yes'
            UNION ALL SELECT pii_type, value, -1 FROM ({_sql(_PII)})),
  refused AS (SELECT value, decided_at AS at0 FROM said WHERE decision = 'no'),
  pii AS (SELECT DISTINCT pii_type, value FROM added a WHERE NOT EXISTS (
            SELECT 1 FROM refused r WHERE (r.value = a.value OR lower(r.value) = a.value)
            AND r.at0 >= (SELECT max(b.at0) FROM added b
                          WHERE b.pii_type = a.pii_type AND b.value = a.value))),
  listed AS (SELECT lower(value) AS value_lc, decided_at AS at0 FROM said WHERE decision = 'no'
             UNION ALL SELECT value_lc, -1 FROM ({_sql(_SAFE)})),
  spoken AS (SELECT lower(value) AS value_lc, max(decided_at) AS at0 FROM said
             WHERE decision = 'yes' GROUP BY 1),
  safe AS (SELECT l.value_lc FROM (SELECT value_lc, max(at0) AS at0 FROM listed GROUP BY 1) l
           LEFT JOIN spoken s USING (value_lc) WHERE s.at0 IS NULL OR l.at0 > s.at0)
  """


@query("apply_feedback", _EVENTS + _both("SELECT * FROM pii", "SELECT * FROM safe"))
def applied_feedback(spark, sf_dir):
    """A batch of yes, no and skip decisions on values in several casings."""
    pii, safe = _state(spark, sf_dir)
    return _merged(*apply_feedback(pii, safe, _frame(spark, sf_dir, _DECISIONS)))


_RANKS = " ".join(f"WHEN {q(t)} THEN {i}" for i, t in enumerate(R.PII_TYPES))
_ASKED = """SELECT DISTINCT value FROM (
  SELECT upper(c_name) AS value FROM {customer} UNION ALL SELECT c_name FROM {customer}
  UNION ALL SELECT s_name FROM {supplier} UNION ALL SELECT lower(s_name) FROM {supplier})"""


_MORE = "CASE WHEN c_nationkey = 5 THEN c_name ELSE c_name || '@corp.io' END"


@query(
    "look_up_values",
    f"""WITH pii AS ({_sql(_PII)} UNION SELECT 'email', {_MORE} FROM customer),
    safe AS ({_sql(_SAFE)}), asked AS ({_sql(_ASKED)})
    SELECT value, (SELECT arg_min(pii_type, CASE pii_type {_RANKS} END) FROM pii p
                   WHERE p.value = a.value OR p.value = lower(a.value)) AS known_type,
      lower(value) IN (SELECT value_lc FROM safe) AS known_safe FROM asked a""",
)
def looked_up_values(spark, sf_dir):
    pii, safe = _state(spark, sf_dir)
    more = _frame(
        spark, sf_dir,
        f"SELECT 'email' AS pii_type, {_MORE} AS value FROM {{customer}}",
    )
    asked = _frame(spark, sf_dir, _ASKED)
    return look_up(asked, pii.union(more).distinct(), safe)


_PATTERNS = """SELECT 'p' || cast(s_suppkey % 40 AS {string}) AS name,
  '^' || s_name || '$' AS pattern, 'company_name' AS pii_type,
  CAST(0.9 AS double) AS confidence, {stamp}(s_suppkey) AS created_at FROM {supplier}"""


def _patterns(spark, sf_dir):
    return _frame(
        spark, sf_dir,
        _PATTERNS.replace("{string}", "string").replace("{stamp}", "timestamp_seconds"),
    )


def _other_patterns(patterns):
    """The same names at other times: a third earlier, the others later."""
    at = F.unix_seconds("created_at")
    moved = at - F.when(at % 3 == 0, 1_000_000).otherwise(-1_000_000)
    return patterns.withColumn("pattern", F.concat(F.lit("early"), "pattern")).withColumn(
        "created_at", F.timestamp_seconds(moved)
    )


@query(
    "upsert_patterns",
    f"""WITH q AS ({_PATTERNS.format(string='varchar', stamp='', supplier='supplier')}),
    p AS (SELECT * FROM q UNION ALL SELECT name, 'early' || pattern, pii_type, confidence,
          created_at - CASE WHEN created_at % 3 = 0 THEN 1000000 ELSE -1000000 END FROM q)
    SELECT name, arg_max(pattern, created_at) AS pattern, 'company_name' AS pii_type,
      CAST(max(created_at) AS BIGINT) AS seconds FROM p
    WHERE name NOT IN (SELECT 'p' || cast(n_nationkey AS varchar) FROM nation) GROUP BY name""",
)
def upserted_patterns(spark, sf_dir):
    """Patterns by name, last write wins; those named by a nation are removed."""
    patterns = _patterns(spark, sf_dir)
    kept = upsert_patterns(upsert_patterns(patterns.limit(0), _other_patterns(patterns)), patterns)
    names = table(spark, sf_dir, "nation").select(
        F.expr("concat('p', cast(n_nationkey AS string)) AS name")
    )
    out = remove_patterns(kept, names)
    return out.select(
        "name", "pattern", "pii_type", F.unix_seconds("created_at").alias("seconds")
    )


@query(
    "learning_stats",
    f"""SELECT 'pii' AS kind, pii_type, count(*) AS total FROM ({_sql(_PII)}) GROUP BY ROLLUP (pii_type)
    UNION ALL SELECT 'safe', NULL, count(*) FROM supplier
    UNION ALL SELECT 'custom_patterns', NULL, count(DISTINCT s_suppkey % 40) FROM supplier""",
)
def stats_of_learning(spark, sf_dir):
    pii, safe = _state(spark, sf_dir)
    patterns = _patterns(spark, sf_dir)
    store = upsert_patterns(patterns.limit(0), _other_patterns(patterns))
    return learning_stats(pii, safe, upsert_patterns(store, patterns))


@query(
    "export_and_import_learned",
    _both(
        f"{_sql(_PII)} UNION {_sql(_NEW_PII)}",
        f"{_sql(_SAFE)} UNION SELECT lower(value) FROM ({_sql(_NEW_SAFE)})",
    ),
)
def exported_and_imported(spark, sf_dir):
    """Export one store as JSON rows, merge it into another."""
    pii, safe = _state(spark, sf_dir)
    path = f"{shared_folder(spark)}/learned-{uuid.uuid4().hex}"
    export_learned(pii, safe, path)
    read_pii, read_safe, _ = read_learned(spark, path)
    own_pii = _frame(spark, sf_dir, _NEW_PII)
    own_safe = _frame(spark, sf_dir, _NEW_SAFE).select(F.lower("value").alias("value_lc"))
    return _merged(*import_learned(own_pii, own_safe, read_pii, read_safe))


@query("replace_learned", _both(f"SELECT DISTINCT * FROM ({_sql(_PII)})", _sql(_SAFE)))
def replaced_learned(spark, sf_dir):
    """Import an export in place of what was there, after a clear."""
    pii, safe = _state(spark, sf_dir)
    path = f"{shared_folder(spark)}/learned-{uuid.uuid4().hex}"
    export_learned(pii, safe, path, _patterns(spark, sf_dir))
    read_pii, read_safe, _ = read_learned(spark, path)
    own = clear_learned(_frame(spark, sf_dir, _NEW_PII), safe)
    return _merged(*import_learned(*own, read_pii, read_safe, merge=False))


@query(
    "import_patterns",
    f"""WITH q AS ({_PATTERNS.format(string='varchar', stamp='', supplier='supplier')}),
    own AS (SELECT name, arg_max(pattern, created_at) AS pattern, 0.9 AS confidence FROM q
            GROUP BY name),
    new AS (SELECT 'p' || n_nationkey AS name, n_name AS pattern,
            0.5 + n_regionkey / 10.0 AS confidence FROM nation)
    SELECT name, pattern, CAST(confidence AS DOUBLE) AS confidence FROM own
    WHERE name NOT IN (SELECT name FROM new)
    UNION ALL SELECT name, pattern, CAST(confidence AS DOUBLE) FROM new""",
)
def imported_patterns(spark, sf_dir):
    """Patterns keep their confidence through a file; those imported win, also
    after a clear of another store."""
    patterns = _patterns(spark, sf_dir)
    own = upsert_patterns(patterns.limit(0), patterns)
    new = table(spark, sf_dir, "nation").selectExpr(
        "concat('p', n_nationkey) AS name", "n_name AS pattern", "'custom' AS pii_type",
        "0.5D + n_regionkey / 10.0D AS confidence", "timestamp_seconds(0) AS created_at",
    )
    path = f"{shared_folder(spark)}/patterns-{uuid.uuid4().hex}"
    pii, safe = _state(spark, sf_dir)
    export_learned(pii, safe, path, new)
    _, _, read = read_learned(spark, path)
    merged = import_patterns(own, import_patterns(clear_patterns(own), read))
    return merged.select("name", "pattern", F.round("confidence", 6).alias("confidence"))


@query("learned_object", _both(f"SELECT DISTINCT * FROM ({_sql(_PII)})", _sql(_SAFE)))
def learned_object_round_trip(spark, sf_dir):
    """The version-1 object, written and read as one."""
    pii, safe = _state(spark, sf_dir)
    path = f"{shared_folder(spark)}/object-{uuid.uuid4().hex}"
    patterns = _patterns(spark, sf_dir)
    learned_object(pii, safe, upsert_patterns(patterns.limit(0), patterns)).write.text(path)
    read_pii, read_safe, _ = read_learned_object(spark, path)
    return _merged(read_pii, read_safe)
