"""Sessions: redact texts, queue uncertain spans, confirm, redact again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from ..operators.detect import Detector
from ..operators.learning import apply_feedback
from ..operators.mapping import clear_scopes, live_sessions, open_session
from ..operators.redact import (
    NO_LAYERS,
    REVIEWED,
    SAFE,
    SKIP_UNCERTAIN,
    Layers,
    Policy,
    Redaction,
    redact_units,
    unit_spans,
)
from ..operators.review import as_decisions, remaining, review_queue


def session_units(
    texts: DataFrame, session_id: str, unit_no: str, text: str = "text"
) -> DataFrame:
    """Session texts as units; a session is its own scope and document."""
    return texts.select(
        F.col(session_id).alias("scope_id"),
        F.col(session_id).alias("doc_id"),
        F.lit("message").alias("part"),
        F.col(unit_no).cast("int").alias("unit_no"),
        F.col(text).alias("text"),
    )


def open_sessions(texts: DataFrame, session_id: str, created_at: Column) -> DataFrame:
    """``sessions``: first text opens a session, which ends an hour later."""
    return (
        texts.groupBy(F.col(session_id).alias("session_id"))
        .agg(F.min(created_at).alias("created_at"))
        .withColumn("expires_at", open_session(F.col("created_at")))
    )


@dataclass(frozen=True)
class SessionRun:
    redaction: Redaction
    queue: DataFrame


def start_sessions(
    units: DataFrame,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    layers: Layers = NO_LAYERS,
) -> SessionRun:
    """Redact the certain spans and queue the uncertain ones."""
    found = unit_spans(units, detector, policy, context=True, layers=layers)
    spans = stage(found, "sessions")
    redaction = redact_units(
        units, policy=policy, mode=SKIP_UNCERTAIN, spans=spans, document_scopes=True
    )
    return SessionRun(redaction, review_queue(spans, document_scopes=True))


def confirm(
    run: SessionRun, units: DataFrame, answers: DataFrame, policy: Policy = SAFE
) -> SessionRun:
    """Apply answers ``(scope_id, idx, decision, type_override, decided_at)``.

    Values that have a placeholder keep it; confirmed values continue the
    numbers.  The texts are spliced again, so a confirmed value is gone.
    """
    decisions = as_decisions(run.queue, answers)
    redaction = redact_units(
        units,
        policy=policy,
        mode=REVIEWED,
        decisions=decisions,
        existing=run.redaction.mapping,
        spans=run.redaction.spans,
        document_scopes=True,
    )
    return SessionRun(redaction, remaining(run.queue, answers))


def learn_from(
    run: SessionRun, answers: DataFrame, pii: DataFrame, safe: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The learned tables after the answers."""
    return apply_feedback(pii, safe, as_decisions(run.queue, answers))


def drop_expired(
    mapping: DataFrame, sessions: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Live sessions, and the mapping without the scopes of the others."""
    live = live_sessions(sessions, now)
    gone = sessions.join(live.select("session_id"), "session_id", "left_anti").select(
        F.col("session_id").alias("scope_id")
    )
    return live, clear_scopes(mapping, gone)
