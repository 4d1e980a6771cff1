"""Entity intake: entities of a user's own model become spans.

The model runs outside (for example in the user's ``mapInPandas``) and hands in
rows ``(doc_id, unit_no, label, start, end)``; here they are cleaned, typed and
anchored with Spark SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.expr import (
    Sql,
    case,
    keep,
    let,
    strip,
    text_list,
    text_literal,
    transform,
)
from ..functions.spans import make_span, priority_of


def _words(text: Sql) -> Sql:
    spaces = text_literal(r"(?U)[\s\x1c-\x1f]+")
    return f"split({text}, {spaces})"


def clean_person(text: Sql) -> Sql:
    """The leading run of capitalised words; NULL if it is over three words."""
    pattern = text_literal(R.java_regex(R.ENTITY_PERSON_RUN, False))
    run = f"coalesce(nullif(regexp_extract({text}, {pattern}, 1), ''), {text})"
    return let(
        run,
        lambda k: f"if(size({_words(strip(k))}) <= {R.ENTITY_PERSON_MAX_WORDS}, "
        f"{k}, NULL)",
    )


def clean_org(text: Sql) -> Sql:
    """The first line; a leading document word goes if a company name follows,
    else the entity is dropped (NULL)."""
    prefixes = text_list(R.ENTITY_ORG_PREFIXES)

    def company(tail: Sql) -> Sql:
        return " OR ".join(
            f"contains(lower({tail}), {text_literal(m)})" for m in R.ENTITY_ORG_MARKERS
        )

    def rest(line: Sql) -> Sql:
        prefixed = f"exists(array({prefixes}), p -> startswith(lower({line}), p))"
        tail = f"array_join(slice({_words(line)}, 2, size({_words(line)})), ' ')"
        named = let(tail, lambda t: f"if({company(t)}, {t}, NULL)")
        return f"if({prefixed}, {named}, {line})"

    return let(strip(f"substring_index({text}, '\\n', 1)"), rest)


def clean_entity(label: Sql, text: Sql) -> Sql:
    """Cleaned entity text, or NULL where the entity is a false positive."""
    stripped = strip(text)
    cleaned = case(
        label,
        {
            "PERSON": let(stripped, clean_person),
            "ORG": let(stripped, clean_org),
        },
        stripped,
    )
    stop_word = f"{strip(f'lower({text})')} IN ({text_list(R.ENTITY_STOP_WORDS)})"
    holds_ip = f"{text} RLIKE {text_literal(R.java_regex(R.ENTITY_IP, False))}"
    return let(
        cleaned,
        lambda c: f"if({label} IN ({text_list(R.ENTITY_LABELS)}) "
        f"AND NOT {stop_word} AND NOT {holds_ip} AND length({c}) >= 2, {c}, NULL)",
    )


def anchor(text: Sql, cleaned: Sql, start: Sql) -> Sql:
    """First occurrence of the cleaned text at or after the entity's start."""
    return let(
        f"locate({cleaned}, {text}, {start} + 1) - 1",
        lambda at: f"if({at} >= 0, {at}, {start})",
    )


def entity_spans(text: Sql, entities: Sql, earlier: Sql, threshold: float) -> Sql:
    """Spans of one text's entities (``array<struct<start,end,label>>``).

    An entity whose raw span is already claimed by an earlier layer is dropped
    before the clean-up moves its borders.
    """

    def build(entity: Sql, i: Sql) -> Sql:
        label = f"{entity}.label"
        raw = (
            f"substr({text}, {entity}.start + 1, {entity}.end - {entity}.start)"
        )
        pii_type = case(label, {k: f"'{t}'" for k, (t, _) in R.ENTITY_LABELS.items()})
        confidence = case(label, {k: str(c) for k, (_, c) in R.ENTITY_LABELS.items()})

        def place(cleaned: Sql) -> Sql:
            return let(
                anchor(text, cleaned, f"{entity}.start"),
                lambda at: make_span(
                    at, f"{at} + length({cleaned})", cleaned, pii_type,
                    priority_of(pii_type), confidence, R.LAYER_ENTITY, i,
                    "'entity'",
                    f"if({confidence} >= {threshold}, 'match', 'uncertain')",
                ),
            )

        return let(raw, lambda r: let(clean_entity(label, r), place))

    def unclaimed(claims: Sql) -> Sql:
        return keep(
            entities,
            lambda e: f"NOT array_contains({claims}, struct({e}.start, {e}.end))",
        )

    claims = transform(earlier, lambda s: f"struct({s}.start, {s}.end)")
    built = transform(let(claims, unclaimed), build, arity=2)
    return keep(built, lambda s: f"{s}.text IS NOT NULL")


def with_entities(units: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Attach each unit's entities as an array column ``entities``.

    A unit's entities are bounded by its text; units without any keep an empty
    array.  A unit key is unique, so no key is hot.
    """
    grouped = entities.groupBy(*keys).agg(
        F.expr(
            "array_sort(collect_list(struct(cast(start AS int) AS start, "
            "cast(end AS int) AS end, label))) AS entities"
        )
    )
    none = F.expr("cast(array() AS array<struct<start:int,end:int,label:string>>)")
    return units.join(grouped, keys, "left").withColumn(
        "entities", F.coalesce("entities", none)
    )
