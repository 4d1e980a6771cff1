"""The review queue of uncertain spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import number_in_scope


def review_queue(
    spans: DataFrame, doc_id: str = "doc_id", document_scopes: bool = False
) -> DataFrame:
    """Uncertain spans with their index inside the scope, from 0, in text order.

    A scope may be a session or a whole corpus; it is numbered in blocks.  Pass
    staged spans: they are read once per level.
    """
    uncertain = spans.where(F.col("status") == "uncertain").withColumn(
        "doc_ord", F.col(doc_id)
    )
    numbered = number_in_scope(
        uncertain, ["scope_id"], ("doc_ord", "unit_no", "start"), "idx", document_scopes
    )
    return numbered.withColumn("idx", (F.col("idx") - 1).cast("int")).drop("doc_ord")


def remaining(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """The queue without the decided ``(scope_id, idx)`` rows; the indexes of
    the others stay."""
    return queue.join(
        decided.select("scope_id", "idx").distinct(), ["scope_id", "idx"], "left_anti"
    )


def as_decisions(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """Turn answers ``(scope_id, idx, decision, type_override, decided_at)`` into
    decision rows; answers to unknown indexes fall out."""
    return queue.join(answers, ["scope_id", "idx"]).select(
        "scope_id",
        "pii_type",
        F.col("text").alias("value"),
        "decision",
        "type_override",
        "decided_at",
    )


def unknown_answers(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers that name no open match, with the reason."""
    return answers.join(
        queue.select("scope_id", "idx"), ["scope_id", "idx"], "left_anti"
    ).withColumn("error", F.lit("match not found"))
