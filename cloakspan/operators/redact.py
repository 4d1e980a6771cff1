"""Redaction: detect, arbitrate, decide, number, splice, report.

Two plans.  :func:`redact_rows` is for texts that are their own scope (a
document, a pasted text): everything about a text happens in its row, without
a shuffle.  :func:`redact_units` is for scopes of many units (documents cut
into paragraphs, sessions, a whole corpus): spans become rows, the mapping is
built from them, and each unit's edits come back to its text by one join.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import (
    Sql,
    compute_once,
    empty,
    exists,
    is_blank,
    keep,
    let,
    struct,
    transform,
)
from ..functions.joins import join_unique
from ..functions.placeholders import number_in_row, taken_numbers
from ..functions.spans import (
    context_of,
    count_by_type,
    no_spans,
    splice,
    splice_from_right,
)
from ..functions.staging import stage
from ..functions.windows import windows
from ..schemas import SPAN_ARRAY, TAKEN_ARRAY
from .arbitrate import arbitrate, first_claims, of_status, resolve_overlaps
from .detect import SPAN_FIELDS, Detector, detect_spans, raw_spans
from .dictionary import dictionary_spans, drop_safe_table
from .entities import with_entities
from .learning import pattern_rules
from .mapping import assign_placeholders, extend_mapping
from .patterns import pattern_spans

UNIT = ["scope_id", "doc_id", "unit_no"]


@dataclass(frozen=True)
class Policy:
    """How spans are chosen, numbered and spliced.

    The default is the safe behaviour: containing spans win, every occurrence
    is replaced, accepted spans never overlap.  :meth:`reference` reproduces
    the original tool's choices, leaks included.
    """

    order: str = "longest"
    repeats: str = "all"
    numbering: str = "reading"
    sequential_splice: bool = False
    avoid_taken: bool = True  # give out no placeholder that stands in the source

    @staticmethod
    def reference() -> "Policy":
        return Policy("reference", "first", "reference", True, False)


SAFE = Policy()

# Decision modes: accept every uncertain span, skip them, or ask a table.
ACCEPT_ALL = "all"
SKIP_UNCERTAIN = "skip"
REVIEWED = "reviewed"


def _claims(
    text: Sql, detector: Detector, entities: Sql | None, parts: Sql | None = None
) -> Sql:
    """Detected spans before arbitration; none for blank texts."""
    claimed = detect_spans(text, detector, entities, parts)
    if detector.learned_pii or detector.custom_patterns:
        claimed = f"if({is_blank(text)}, {no_spans()}, {claimed})"
    return claimed


def found_spans(
    text: Sql,
    detector: Detector,
    policy: Policy = SAFE,
    entities: Sql | None = None,
) -> Sql:
    """Detected and arbitrated spans of a text."""
    return arbitrate(_claims(text, detector, entities), policy.order, policy.repeats)


def with_found_spans(
    df: DataFrame,
    detector: Detector,
    policy: Policy = SAFE,
    text: str = "text",
    entities: str | None = None,
) -> DataFrame:
    """``df`` with ``_found``, the spans of :func:`found_spans`, and ``_windows``, one
    step at a time: a nest of all steps of a redaction is too deep for the analyzer."""
    claimed = let(
        windows(text), lambda w: struct(_windows=w, _claimed=_claims(text, detector, entities, w))
    )
    worked = df.select("*", F.expr(f"inline(array({claimed}))"))
    chosen = arbitrate("_claimed", policy.order, policy.repeats)
    return compute_once(worked, _found=chosen).drop("_claimed")


def accepted_spans(spans: Sql, mode: str, policy: Policy) -> Sql:
    """The spans to redact when no review table takes part."""
    if mode == SKIP_UNCERTAIN:
        return of_status(spans, "match")
    if mode != ACCEPT_ALL:
        raise ValueError(f"mode {mode!r} needs a decisions table")
    if policy.sequential_splice:
        return spans
    return resolve_overlaps(spans, policy.order, "all")


def _last_first(spans: Sql) -> Sql:
    """Last start first; at an equal start the match before the uncertain."""
    keyed = transform(
        spans, lambda s: struct(k0=f"-{s}.start", k1=f"{s}.status", span=s)
    )
    return transform(f"array_sort({keyed})", lambda k: f"{k}.span")


def _numbering_order(spans: Sql, policy: Policy) -> Sql:
    """Spans in the order in which they take their numbers."""
    return spans if policy.numbering == "reading" else _last_first(spans)


def _apply(text: Sql, numbered: Sql, policy: Policy) -> Sql:
    if policy.sequential_splice:
        return splice_from_right(text, numbered)
    if policy.numbering == "reading":
        return splice(text, numbered)
    return splice(text, f"array_sort({numbered})")


def redact_rows(
    df: DataFrame,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    text: str = "text",
    entities: str | None = None,
) -> DataFrame:
    """Redact texts that are their own scope, without a shuffle.

    Adds ``redacted``, ``total``, ``uncertain``, ``by_type`` and ``spans`` (the
    replaced spans with their placeholder, in numbering order).
    """
    worked = with_found_spans(df, detector or Detector(), policy, text, entities)
    accepted = accepted_spans("_found", mode, policy)
    worked = compute_once(worked, _chosen=_numbering_order(accepted, policy))
    taken = None
    if policy.avoid_taken:
        none = empty(TAKEN_ARRAY)
        worked = compute_once(
            worked, _taken=f"if(size(_chosen) = 0, {none}, {taken_numbers(text, '_windows')})"
        )
        taken = "_taken"
    worked = compute_once(worked, _spans=number_in_row("_chosen", taken))
    edited = _apply(text, "_spans", policy)
    return worked.select(
        *df.columns,
        F.expr(
            f"CASE WHEN size(_spans) = 0 THEN {text} ELSE {edited} END"
        ).alias("redacted"),
        F.expr("cast(size(_spans) AS bigint)").alias("total"),
        F.expr(f"cast(size({of_status('_found', 'uncertain')}) AS bigint)").alias("uncertain"),
        F.expr(count_by_type("_spans")).alias("by_type"),
        F.col("_spans").alias("spans"),
    )


def row_mapping(redacted: DataFrame, keys: list[str]) -> DataFrame:
    """Mapping rows of :func:`redact_rows`: per text and number the first span.

    The rows of a text are told apart inside its own array, so this does not
    shuffle either.
    """
    ranked = transform(
        "spans",
        lambda s, i: struct(
            pii_type=f"{s}.pii_type", n=f"{s}.n", i=i, value_lc=f"{s}.value_lc",
            original=f"{s}.text", placeholder=f"{s}.placeholder",
        ),
        arity=2,
    )

    def firsts(ordered: Sql) -> Sql:
        def is_first(s: Sql, i: Sql) -> Sql:
            before = f"get({ordered}, {i} - 1)"
            return (
                f"({i} = 0 OR {before}.pii_type != {s}.pii_type "
                f"OR {before}.n != {s}.n)"
            )

        return keep(ordered, is_first, arity=2)

    rows = F.expr(f"inline({let(f'array_sort({ranked})', firsts)})")
    return redacted.select(*keys, rows).select(
        *keys, "pii_type", "value_lc", "original", "n", "placeholder"
    )


# -- units ---------------------------------------------------------------------


def _flag_accepted(spans: Sql, mode: str, policy: Policy) -> Sql:
    """Spans with ``accepted``: whether the mode redacts them.

    A review happens later, in a table; until then only matches are accepted.
    """

    def flag(span: Sql, value: Sql) -> Sql:
        fields = {name: f"{span}.{name}" for name in SPAN_FIELDS}
        return struct(**fields, accepted=value)

    if mode in (SKIP_UNCERTAIN, REVIEWED):
        return transform(spans, lambda s: flag(s, f"{s}.status = 'match'"))
    if policy.sequential_splice:
        return transform(spans, lambda s: flag(s, "true"))

    def flag_all(found: Sql) -> Sql:
        chosen = transform(
            accepted_spans(found, mode, policy), lambda k: f"struct({k}.start, {k}.end)"
        )
        return let(
            chosen,
            lambda c: transform(
                found,
                lambda s: flag(s, f"array_contains({c}, struct({s}.start, {s}.end))"),
            ),
        )

    return let(spans, flag_all)


@dataclass(frozen=True)
class Layers:
    """Detection layers that are tables.

    ``dictionary`` (``pii_type, value[, rank]``) are learned values, ``safe``
    (``value_lc``) values that are none, ``patterns`` custom patterns, and
    ``entities`` (``scope_id, doc_id, unit_no, label, start, end``) what a
    user's model has found.
    """

    dictionary: DataFrame | None = None
    safe: DataFrame | None = None
    patterns: DataFrame | None = None
    entities: DataFrame | None = None

    def detector(self, detector: Detector | None) -> Detector:
        """``detector``, with the custom patterns where entities need to know
        what these find in a text's row; elsewhere patterns stay a table."""
        detector = detector or Detector()
        if self.patterns is None or self.entities is None:
            return detector
        found = tuple(
            replace(rule, seq=len(detector.custom_patterns) + i)
            for i, rule in enumerate(pattern_rules(self.patterns))
        )
        return replace(detector, custom_patterns=detector.custom_patterns + found)

    @property
    def pattern_table(self) -> DataFrame | None:
        """The custom patterns that are joined with the texts."""
        return self.patterns if self.entities is None else None

    @property
    def joined(self) -> bool:
        """Whether a table is joined with the texts to find spans."""
        tables = (self.dictionary, self.safe, self.pattern_table)
        return any(t is not None for t in tables)

    def attach(self, units: DataFrame) -> tuple[DataFrame, str | None]:
        """Units with their entities, and the name of that column."""
        if self.entities is None:
            return units, None
        return with_entities(units, self.entities, UNIT), "entities"


NO_LAYERS = Layers()


def spans_in_rows(
    units: DataFrame,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    entities: str | None = None,
) -> DataFrame:
    """``units`` with ``_spans``, the arbitrated spans of each with the flag
    ``accepted``, and ``_windows`` (narrow: no shuffle)."""
    worked = with_found_spans(units, detector or Detector(), policy, "text", entities)
    return compute_once(worked, _spans=_flag_accepted("_found", mode, policy)).drop("_found")


def span_rows(spanned: DataFrame, *more: str) -> DataFrame:
    """The spans of :func:`spans_in_rows` as rows."""
    inside = F.expr("inline(_spans)").alias(*SPAN_FIELDS, "accepted")
    return spanned.withColumnRenamed("text", "_body").select(*UNIT, *more, inside)


def unit_spans(
    units: DataFrame,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    entities: str | None = None,
    context: bool = False,
    layers: Layers = NO_LAYERS,
) -> DataFrame:
    """Arbitrated spans of every unit as rows, each with the flag ``accepted``.

    Narrow, unless a dictionary, a safe list or a pattern table takes part.
    """
    detector = layers.detector(detector)
    if layers.entities is not None:
        units, entities = layers.attach(units)
    columns = [*UNIT, *SPAN_FIELDS, "accepted"]
    if layers.joined:
        rows = table_spans(
            units, detector, layers.dictionary, layers.safe, policy, mode, entities,
            layers.pattern_table,
        )
        if context:
            texts = units.select(*UNIT, F.col("text").alias("_body"))
            rows = rows.join(texts, UNIT)
    else:
        spanned = spans_in_rows(units, detector, policy, mode, entities)
        rows = span_rows(spanned, "_body")
    if context:
        rows = rows.withColumn("context", F.expr(context_of("_body", "start", "end")))
        columns.append("context")
    return rows.select(*columns)


def table_spans(
    units: DataFrame,
    detector: Detector,
    dictionary: DataFrame | None = None,
    safe: DataFrame | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    entities: str | None = None,
    patterns: DataFrame | None = None,
) -> DataFrame:
    """Arbitrated spans when the dictionary, the safe list or the custom
    patterns are tables."""
    found = raw_spans("_body", detector, entities, "_windows")
    bodies = compute_once(units.withColumnRenamed("text", "_body"), _windows=windows("_body"))
    raw = bodies.select(
        *UNIT, F.expr(f"inline({found})").alias(*SPAN_FIELDS)
    )
    if dictionary is not None:
        raw = raw.unionByName(
            dictionary_spans(units.select(*UNIT, "text"), dictionary, detector.learned_boundary)
        )
    if patterns is not None:
        custom = pattern_spans(
            units.select(*UNIT, "text"), patterns, len(detector.custom_patterns), detector.threshold
        )
        if detector.learned_safe:
            custom = custom.where(~F.lower("text").isin(*detector.learned_safe))
        raw = raw.unionByName(custom)
    if safe is not None:
        raw = drop_safe_table(raw, safe)
    return arbitrate_table(raw, policy, mode)


def arbitrate_table(
    spans: DataFrame, policy: Policy = SAFE, mode: str = SKIP_UNCERTAIN
) -> DataFrame:
    """Claims and overlaps for span rows from several sources.

    A unit's spans come together in one array, which its text bounds.
    """
    claims = F.collect_list(F.struct(*SPAN_FIELDS)).cast(SPAN_ARRAY)
    chosen = arbitrate(first_claims("claims"), policy.order, policy.repeats)
    flagged = _flag_accepted(chosen, mode, policy)
    return (
        spans.groupBy(*UNIT)
        .agg(claims.alias("claims"))
        .select(*UNIT, F.expr(f"inline({flagged})").alias(*SPAN_FIELDS, "accepted"))
    )


def decide(
    spans: DataFrame,
    mode: str,
    policy: Policy = SAFE,
    decisions: DataFrame | None = None,
) -> DataFrame:
    """The spans to redact.

    Outside a review these are the accepted rows.  ``decisions`` rows are
    ``(scope_id, pii_type, value, decision, type_override, decided_at)``; the last
    ``yes`` or ``no`` of a value counts: ``yes`` accepts an uncertain span (under
    the override type, if given), ``no`` leaves it in the text, and so does a
    missing decision.
    """
    if mode != REVIEWED:
        return spans.where("accepted").select(*UNIT, *SPAN_FIELDS)
    if decisions is None:
        raise ValueError("reviewed mode needs a decisions table")
    reviewed = apply_decisions(spans, decisions)
    if policy.sequential_splice:
        return reviewed
    chosen = F.collect_list(F.struct(*SPAN_FIELDS)).cast(SPAN_ARRAY)
    resolved = resolve_overlaps("chosen", policy.order, "all")
    return (
        reviewed.groupBy(*UNIT)
        .agg(chosen.alias("chosen"))
        .select(*UNIT, F.expr(f"inline({resolved})").alias(*SPAN_FIELDS))
    )


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last ``yes`` or ``no`` of each (scope, type, value), with its override
    type; a ``skip`` changes nothing, as in the learned tables.

    Of decisions made at one time ``yes`` counts, then the later override type
    in the alphabet.
    """
    at = F.col("decided_at") if "decided_at" in decisions.columns else F.lit(0)
    said = F.struct("decision", "type_override")
    return (
        decisions.where(F.col("decision").isin("yes", "no"))
        .groupBy("scope_id", "pii_type", "value")
        .agg(F.max_by(said, F.struct(at, "decision", "type_override")).alias("said"))
        .select("scope_id", "pii_type", "value", "said.*")
    )


def apply_decisions(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Matches, and the uncertain spans that a review accepted at last."""
    yes = last_decisions(decisions).where(F.col("decision") == "yes").select(
        "scope_id", "pii_type", F.col("value").alias("text"), "type_override",
        F.lit(True).alias("_yes"),
    )
    joined = spans.join(yes, ["scope_id", "pii_type", "text"], "left")
    kept = joined.where((F.col("status") == "match") | F.col("_yes"))
    uncertain = F.col("status") == "uncertain"
    return kept.withColumn(
        "pii_type",
        F.when(uncertain, F.coalesce("type_override", "pii_type")).otherwise(
            F.col("pii_type")
        ),
    ).select(*UNIT, *SPAN_FIELDS)


def edits_of(accepted: DataFrame, mapping: DataFrame) -> DataFrame:
    """Accepted spans with their placeholder."""
    keyed = accepted.withColumn("value_lc", F.lower("text"))
    on = ["scope_id", "pii_type", "value_lc"]
    return join_unique(
        keyed, mapping.select(*on, "n", "placeholder"), on, ["doc_id", "unit_no", "start"]
    )


def splice_units(
    units: DataFrame,
    edits: DataFrame,
    policy: Policy = SAFE,
    gate: Sql | None = None,
) -> DataFrame:
    """Put the placeholders into the units' texts.

    Texts shuffle once, to meet their edits.  With ``gate`` (a condition that
    every text with edits meets) the other texts do not shuffle at all.
    """
    per_unit = edits.groupBy(*UNIT).agg(
        F.collect_list(
            F.struct("start", "end", "placeholder", "status")
        ).alias("edits")
    )
    if policy.sequential_splice:
        spliced = splice_from_right("text", _last_first("edits"))
    else:
        spliced = splice("text", "array_sort(edits)")
    return join_edits(units, per_unit, spliced, "redacted", gate)


def join_edits(
    units: DataFrame,
    per_unit: DataFrame,
    changed: Sql,
    out: str,
    gate: Sql | None = None,
    unchanged: Sql = "text",
) -> DataFrame:
    """``units`` with the column ``out``: ``changed`` where the unit has
    ``edits``, else ``unchanged``."""
    touched = units if gate is None else units.where(gate)
    done = (
        touched.join(per_unit, UNIT, "left")
        .withColumn(out, F.expr(f"if(edits IS NULL, {unchanged}, {changed})"))
        .drop(*(c for c in per_unit.columns if c not in units.columns))
    )
    if gate is None:
        return done
    clean = units.where(f"NOT coalesce({gate}, false)")
    return done.unionByName(clean.withColumn(out, F.expr(unchanged)))


@dataclass(frozen=True)
class Redaction:
    """Result tables of a run."""

    texts: DataFrame  # units with ``redacted``
    spans: DataFrame  # all arbitrated spans
    edits: DataFrame  # replaced spans with their placeholder
    mapping: DataFrame  # plain mapping of the values seen in this run


def redact_units(
    units: DataFrame,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    decisions: DataFrame | None = None,
    existing: DataFrame | None = None,
    spans: DataFrame | None = None,
    document_scopes: bool = False,
    layers: Layers = NO_LAYERS,
) -> Redaction:
    """Redact units whose scope spans many rows.

    ``units``: ``scope_id, doc_id, unit_no, text``.  The source is read once and
    staged with its spans; texts without a span that may be replaced do not
    shuffle.  (With a dictionary, a safe list or patterns the units are read by each
    layer, and all of them meet their edits by a join.)  ``existing`` is a plain
    mapping to continue.  ``spans`` are staged spans of an earlier run over the
    same units.  ``document_scopes`` says that every scope is one document or
    session.
    """
    columns = units.columns
    gate = None
    in_rows = spans is None and not layers.joined
    if in_rows:
        units, entities = layers.attach(units)
        units = spans_in_rows(units, layers.detector(detector), policy, mode, entities)
        gate = "size(_spans) > 0"
        if mode != REVIEWED:
            gate = exists("_spans", lambda s: f"{s}.accepted")
    if policy.avoid_taken:
        parts = "_windows" if in_rows else None
        units = compute_once(units, _taken=taken_numbers("text", parts))
    if in_rows:
        units = stage(units.drop("_windows"), "units")
        spans = span_rows(units)
    elif spans is None:
        spans = stage(unit_spans(units, detector, policy, mode, layers=layers), "spans")
    taken = None
    if policy.avoid_taken:
        found = units.select("scope_id", F.expr("inline(_taken)").alias("pii_type", "n"))
        taken = stage(found.distinct(), "taken")
    accepted = decide(spans, mode, policy, decisions)
    if mode == REVIEWED:
        accepted = stage(accepted, "accepted")
    numbered = dict(document_scopes=document_scopes, taken=taken)
    if existing is None:
        mapping = assign_placeholders(accepted, policy.numbering, **numbered)
    else:
        mapping = extend_mapping(existing, accepted, policy.numbering, **numbered)
    mapping = known = stage(mapping, "mapping")
    if existing is not None:
        known = existing.select(*MAPPED).unionByName(mapping.select(*MAPPED))
    edits = edits_of(accepted, known)
    texts = splice_units(units, edits, policy, gate).select(*columns, "redacted")
    return Redaction(texts, spans, edits, mapping)


MAPPED = ["scope_id", "pii_type", "value_lc", "original", "n", "placeholder"]
