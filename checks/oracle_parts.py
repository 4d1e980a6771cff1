"""Building blocks of the DuckDB statements: CTEs for hits, spans, arbitration,
numbering and splicing.  Every function returns one or more CTE definitions."""

from __future__ import annotations

from cloakspan import rules as R


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# RE2 has an ASCII \b.  Accented Latin letters become '_' (a word character that
# is in none of the classes in question), so offsets and word borders hold.
MASKED = "regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g')"


def source(name: str, sql_text: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"{name} AS (SELECT {key} AS doc_id, {sql_text} AS text FROM {table})"


def hits(
    name: str, src: str, pattern: str, on: str = "text", group: int = 0
) -> str:
    """Hits with offsets: (doc_id, s, e, t)."""
    p = q(pattern)
    part = f"regexp_extract_all(x, {p}, {group})"
    return f"""{name} AS (
      SELECT doc_id, CAST(e - length(pt) AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
             substr(text, CAST(e - length(pt) + 1 AS BIGINT), length(pt)) AS t
      FROM (SELECT doc_id, text, pt,
                   sum(length(gp) + length(ht)) OVER (PARTITION BY doc_id ORDER BY i) AS e
            FROM (SELECT doc_id, text, unnest(m) AS ht, unnest(n) AS pt,
                         unnest(g[1:len(m)]) AS gp, generate_subscripts(m, 1) AS i
                  FROM (SELECT doc_id, text, regexp_extract_all(x, {p}) AS m,
                               {part} AS n, string_split_regex(x, {p}) AS g
                        FROM (SELECT doc_id, text, {on} AS x FROM {src}))
                  WHERE len(m) > 0)))"""


def handles(name: str, src: str) -> str:
    """Handles without look-around: the longest allowed run after each '@'."""
    return f"""{name} AS (
      SELECT doc_id, p - 1 AS s, p + k AS e, substr(text, p, k + 1) AS t
      FROM (SELECT doc_id, text, p, max(k) AS k
            FROM (SELECT doc_id, text, p, unnest(generate_series(1, 21)) AS k
                  FROM (SELECT doc_id, text, CAST(sum(length(w) + 1) OVER
                               (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS p
                        FROM (SELECT doc_id, text, unnest(ws[1:len(ws)-1]) AS w,
                                     generate_subscripts(ws[1:len(ws)-1], 1) AS i
                              FROM (SELECT doc_id, text, string_split(text, '@') AS ws
                                    FROM {src}))))
            WHERE NOT regexp_matches(substr(text, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END),
                                     '[A-Za-z0-9._%+-]')
              AND regexp_full_match(substr(text, p + 1, k), '[A-Za-z][A-Za-z0-9_-]*')
              AND length(substr(text, p + 1, k)) = k
              AND NOT regexp_matches(substr(text, p + k + 1, 1), '[A-Za-z0-9.]')
              AND regexp_matches(substr(text, p + k, 1), '[A-Za-z0-9_]')
                  <> regexp_matches(substr(text, p + k + 1, 1), '[A-Za-z0-9_À-ÖØ-öø-ɏ]')
            GROUP BY doc_id, text, p))"""


def rule_hits(name: str, src: str, rule: R.Rule) -> str:
    if rule.name == "slack_handle":
        return handles(name, src)
    return hits(name, src, ("(?i)" if rule.ignore_case else "") + rule.pattern)


def name_hits(name: str, src: str) -> str:
    return hits(name, src, R.NAME_PATTERN, on=MASKED)


def name_confidence(t: str) -> str:
    words = f"regexp_split_to_array(lower({t}), '\\s+')"
    first = ", ".join(q(n) for n in R.FIRST_NAMES)
    last = ", ".join(q(n) for n in R.LAST_NAMES)
    a, b = f"{words}[1] IN ({first})", f"{words}[2] IN ({last})"
    return f"CASE WHEN {a} AND {b} THEN 0.7 WHEN {a} OR {b} THEN 0.6 ELSE 0.5 END"


def span_rows(
    hits_name: str, pii_type: str, confidence: str, layer: int, seq: int, status: str
) -> str:
    return (
        f"SELECT doc_id, s, e, t, {q(pii_type)} AS typ, "
        f"CAST({confidence} AS DOUBLE) AS conf, {layer} AS layer, {seq} AS seq, "
        f"{R.TYPE_PRIORITY[pii_type]} AS prio, {q(status)} AS status FROM {hits_name}"
    )


def raw(src: str, names: bool = True, extra: list[str] | None = None) -> list[str]:
    """CTE ``raw`` with the spans of the rule layer and the name layer."""
    ctes, rows = [], []
    for rule in R.REGEX_RULES:
        ctes.append(rule_hits(f"h_{rule.name}", src, rule))
        rows.append(
            span_rows(f"h_{rule.name}", rule.pii_type, str(rule.confidence), 2, rule.seq, "match")
        )
    if names:
        ctes.append(name_hits("h_names", src))
        rows.append(
            span_rows("h_names", "person_name", name_confidence("t"), 5, 0, "uncertain")
        )
    rows += extra or []
    ctes.append("raw AS (" + "\nUNION ALL ".join(rows) + ")")
    return ctes


CLAIMS = """claims AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, s, e ORDER BY layer, seq) AS rn
    FROM raw) WHERE rn = 1)"""


def greedy(
    name: str, src: str, order: str, same_text: bool, by_status: bool = True
) -> list[str]:
    """Greedy overlap resolution, one ranked span per step."""
    keys = {
        "reference": "-conf, -prio, length(t), layer, seq, s, e",
        "longest": "-length(t), -conf, -prio, s, layer, seq, e",
    }[order]
    part = "doc_id, status" if by_status else "doc_id"
    same_status = "AND a.status = r.status" if by_status else ""
    text_clash = "OR x.t = r.t" if same_text else ""
    return [
        f"""{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {keys}) AS k FROM {src})""",
        f"""{name}_walk AS (
  SELECT doc_id, status, k, [struct_pack(s := s, e := e, t := t)] AS kept, true AS ok,
         s, e, t, typ, conf, layer, seq, prio FROM {name}_ranked WHERE k = 1
  UNION ALL
  SELECT r.doc_id, r.status, r.k,
         CASE WHEN len(list_filter(a.kept, lambda x: (x.s < r.e AND x.e > r.s) {text_clash})) > 0
              THEN a.kept ELSE list_append(a.kept, struct_pack(s := r.s, e := r.e, t := r.t)) END,
         len(list_filter(a.kept, lambda x: (x.s < r.e AND x.e > r.s) {text_clash})) = 0,
         r.s, r.e, r.t, r.typ, r.conf, r.layer, r.seq, r.prio
  FROM {name}_walk a JOIN {name}_ranked r
    ON a.doc_id = r.doc_id {same_status} AND r.k = a.k + 1)""",
        f"{name} AS (SELECT doc_id, s, e, t, typ, conf, layer, seq, prio, status "
        f"FROM {name}_walk WHERE ok)",
    ]


def placeholder(typ: str, n: str) -> str:
    arms = []
    for name, template in R.PLACEHOLDER_TEMPLATES.items():
        for width in (4, 2):
            template = template.replace(f"{{n:0{width}d}}", f"%0{width}d")
        text = f"printf({q(template.replace('{n}', '%d'))}, CAST({n} AS INTEGER))"
        if name in R.PLACEHOLDER_LISTS:
            words = "[" + ", ".join(q(w) for w in R.PLACEHOLDER_LISTS[name]) + "]"
            text = (
                f"CASE WHEN {n} <= {len(R.PLACEHOLDER_LISTS[name])} "
                f"THEN {words}[CAST({n} AS INTEGER)] ELSE {text} END"
            )
        arms.append(f"WHEN {q(name)} THEN {text}")
    return f"CASE {typ} {' '.join(arms)} END"


def numbered(
    src: str, scope: str, order: str, name: str = "mapping", offset: str = "0"
) -> list[str]:
    """Mapping rows of accepted spans: (scope, typ, key, original, n, ph)."""
    return [
        f"""{name}_first AS (
  SELECT scope, typ, key, t AS original, ord FROM (
    SELECT {scope} AS scope, typ, lower(t) AS key, t, ({order}) AS ord,
           row_number() OVER (PARTITION BY {scope}, typ, lower(t) ORDER BY ({order})) AS rn
    FROM {src}) WHERE rn = 1)""",
        f"""{name}_n AS (
  SELECT *, {offset} + row_number() OVER (PARTITION BY scope, typ ORDER BY ord) AS n
  FROM {name}_first)""",
        f"{name} AS (SELECT *, {placeholder('typ', 'n')} AS ph FROM {name}_n)",
    ]


def spliced(
    src: str, edits: str, name: str = "spliced", keys: str = "doc_id", out: str = "redacted"
) -> list[str]:
    """Texts with their edits (keys, s, e, ph) put in."""
    using = f"USING ({keys})"
    return [
        f"""{name}_parts AS (
  SELECT {keys}, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last FROM (
    SELECT {keys}, s, e, substr(text, CAST(prev + 1 AS BIGINT), CAST(s - prev AS BIGINT)) || ph AS piece
    FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY {keys} ORDER BY s), 0) AS prev
          FROM {edits}) JOIN {src} {using})
  GROUP BY {keys})""",
        f"""{name} AS (
  SELECT {src}.*, CASE WHEN head IS NULL THEN text
         ELSE head || substr(text, CAST(last + 1 AS BIGINT)) END AS {out}
  FROM {src} LEFT JOIN {name}_parts {using})""",
    ]
