"""Learned dictionaries and safe lists that are tables of any size.

A dictionary of many values is not tried value by value on every text.  Each
value is filed under one short gram, and is compared with a text where that gram
stands (:mod:`cloakspan.operators.occurrences`).  The hits are exactly those of the small
in-row dictionary: substrings, case-blind, each value on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Sql, text_list
from ..functions.spans import make_span, priority_of
from ..rules import LAYER_LEARNED, LEARNED_CONFIDENCE, TYPE_PRIORITY
from .detect import SPAN_FIELDS, fold_case
from .learning import type_rank
from .occurrences import occurrences

UNIT = ["scope_id", "doc_id", "unit_no"]
GRAM = 5


def known_types(pii_type: Sql) -> Sql:
    """Unknown types become ``custom``."""
    return f"if({pii_type} IN ({text_list(TYPE_PRIORITY)}), {pii_type}, 'custom')"


def ranked_dictionary(dictionary: DataFrame) -> DataFrame:
    """``pii_type, value, rank, folded`` of a learned dictionary.

    ``rank`` decides between types that hold the same value: the given column,
    else the fixed order of the types.
    """
    rank = F.col("rank").cast("int") if "rank" in dictionary.columns else type_rank(F.col("pii_type"))
    return (
        dictionary.where(F.length("value") > 0)
        .select(F.expr(known_types("pii_type")).alias("pii_type"), "value", rank.cast("int").alias("rank"))
        .groupBy("pii_type", "value")
        .agg(F.min("rank").alias("rank"))
        .withColumn("folded", F.expr(fold_case("value")))
    )


def dictionary_spans(
    units: DataFrame,
    dictionary: DataFrame,
    boundary: bool = False,
    gram: int = GRAM,
) -> DataFrame:
    """Raw layer-1 spans of a learned dictionary ``(pii_type, value[, rank])``.

    Texts do not shuffle, only the places where a filed gram stands.
    """
    known = ranked_dictionary(dictionary).drop("folded")
    found = occurrences(units, known, ["pii_type", "rank"], boundary=boundary, gram=gram)
    span = make_span(
        "start", "start + length(text)", "text", "pii_type", priority_of("pii_type"),
        str(LEARNED_CONFIDENCE), LAYER_LEARNED, "rank", "'learned'", "'match'",
    )
    return found.select(*UNIT, F.expr(span).alias("s")).select(*UNIT, *(f"s.{c}" for c in SPAN_FIELDS))


def drop_safe_table(spans: DataFrame, safe: DataFrame) -> DataFrame:
    """Drop span rows whose lower text is in ``safe(value_lc)``; learned values
    stay."""
    known = safe.select("value_lc").distinct()
    suppressed = (F.lower(spans["text"]) == known["value_lc"]) & (
        spans["layer"] > LAYER_LEARNED
    )
    return spans.join(known, suppressed, "left_anti")
