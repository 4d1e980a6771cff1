"""Detection layers as one Spark SQL expression per text.

``detect_spans`` keeps a text in its row: the layers append to one array of
span structs, so detection needs no shuffle and no Python worker.  Tables that
are too large for an expression (a big learned dictionary, a big safe list)
take the join paths of :mod:`cloakspan.operators.dictionary`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from .. import rules as R
from ..functions.expr import (
    Sql,
    concat,
    empty,
    keep,
    let,
    struct,
    text_list,
    text_literal,
    transform,
)
from ..functions.spans import hit_pieces, make_span, no_spans, place_pieces, regex_hits
from ..schemas import HIT_ARRAY
from .arbitrate import first_claims, status_of
from .entities import entity_spans

SPAN_FIELDS = (
    "start", "end", "layer", "seq", "text", "pii_type",
    "confidence", "priority", "rule", "status",
)


@dataclass(frozen=True)
class Detector:
    """Which layers run, and with which configuration."""

    rules: tuple[R.Rule, ...] = R.REGEX_RULES
    learned_pii: tuple[tuple[str, str], ...] = ()
    learned_safe: tuple[str, ...] = ()
    custom_patterns: tuple[R.Rule, ...] = ()
    names: bool = True
    contextual: tuple[str, ...] = ()
    learned_boundary: bool = False
    threshold: float = R.AUTO_THRESHOLD

    def with_custom_pattern(
        self,
        pattern: str,
        pii_type: str = "custom",
        confidence: float = R.CUSTOM_CONFIDENCE,
        name: str | None = None,
    ) -> "Detector":
        """Add a case-sensitive pattern (Java regex syntax)."""
        seq = len(self.custom_patterns)
        rule = R.Rule(
            name or f"custom_{seq}", known_type(pii_type), pattern, confidence,
            R.LAYER_CUSTOM, seq, ignore_case=False,
        )
        return replace(self, custom_patterns=self.custom_patterns + (rule,))

    def with_learned(
        self, pii: Iterable[tuple[str, str]] = (), safe: Iterable[str] = ()
    ) -> "Detector":
        return replace(
            self,
            learned_pii=self.learned_pii + tuple(pii),
            learned_safe=self.learned_safe + tuple(v.lower() for v in safe),
        )


def known_type(pii_type: str) -> str:
    """Unknown types become ``custom``."""
    return pii_type if pii_type in R.TYPE_PRIORITY else "custom"


def escape_regex(value: str) -> str:
    """Quote a literal so that only letters and digits stay bare."""
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in value)


def literal_regex(value: str, boundary: bool) -> str:
    body = escape_regex(value)
    if boundary:
        body = rf"(?<![\p{{L}}\p{{N}}_]){body}(?![\p{{L}}\p{{N}}_])"
    return R.java_regex(body, ignore_case=True)


def fold_case(text: Sql) -> Sql:
    """A coarse case fold: texts equal under case-blind matching fold alike.

    Upper case does not depend on the neighbours of a letter, lower case does
    (final sigma).  The signs that have no upper case of their own are replaced.
    """
    signs = r"translate(upper(%s), '\u0130\u212a\u212b\u2126\u03f4', 'IK\u00c5\u03a9\u0398')"
    return f"replace({signs % text}, '\\u1e9e', 'SS')"


def rule_hits(text: Sql, rule: R.Rule) -> Sql:
    """Hits of one rule; the rule's gate keeps clean texts off the pattern."""
    hits, gate = regex_hits(text, text_literal(rule.regex)), _gate(text, rule)
    return hits if gate is None else f"CASE WHEN {gate} THEN {hits} ELSE {empty(HIT_ARRAY)} END"


def _gate(text: Sql, rule: R.Rule) -> Sql | None:
    if rule.gate_literal is not None:
        return f"contains({text}, {text_literal(rule.gate_literal)})"
    if rule.gate_regex is not None:
        return f"{text} RLIKE {text_literal(rule.gate_regex)}"
    return None


def _entry(
    pieces: Sql, pii_type: str, confidence: Sql, layer: int, seq: int, rule: str, status: str
) -> Sql:
    """The hits of one pattern, still without offsets, and what their spans share."""
    return struct(
        pieces=pieces,
        pii_type=text_literal(pii_type),
        priority=str(R.TYPE_PRIORITY.get(pii_type, 0)),
        confidence=f"cast({confidence} AS double)",
        layer=str(layer),
        seq=str(seq),
        rule=text_literal(rule),
        status=text_literal(status),
    )


def rule_entry(text: Sql, rule: R.Rule, threshold: float) -> Sql:
    """The entry of one rule, behind the rule's gate."""
    pieces, gate = hit_pieces(text, text_literal(rule.regex)), _gate(text, rule)
    if gate is not None:
        pieces = f"CASE WHEN {gate} THEN {pieces} END"
    status = status_of(rule.layer, rule.confidence, threshold)
    return _entry(pieces, rule.pii_type, str(rule.confidence), rule.layer, rule.seq, rule.name, status)


def name_entry(text: Sql) -> Sql:
    """Two capitalised words; the name lists only set the confidence."""
    regex = R.java_regex(R.NAME_PATTERN, ignore_case=False, guard=R.NAME_GUARD)
    pieces = hit_pieces(text, text_literal(regex))
    return _entry(pieces, "person_name", "NULL", R.LAYER_NAMES, 0, "name_bigram", "uncertain")


def _name_confidence(value: Sql) -> Sql:
    spaces = text_literal(R.java_regex(r"\s+", ignore_case=False))

    def score(words: Sql) -> Sql:
        first = f"get({words}, 0) IN ({text_list(R.FIRST_NAMES)})"
        last = f"get({words}, 1) IN ({text_list(R.LAST_NAMES)})"
        return (
            f"CASE WHEN {first} AND {last} THEN {R.NAME_BOTH_KNOWN} "
            f"WHEN {first} OR {last} THEN {R.NAME_ONE_KNOWN} "
            f"ELSE {R.NAME_NONE_KNOWN} END"
        )

    return let(f"split(lower({value}), {spaces})", score)


def contextual_entry(text: Sql, pii_type: str, seq: int = 0) -> Sql:
    """Capitalised phrases after a keyword of the type (opt-in layer)."""
    guard = R.contextual_guard(pii_type)
    regex = R.java_regex(R.contextual_pattern(pii_type), ignore_case=True, guard=guard)
    pieces = hit_pieces(text, text_literal(regex), group=2)
    return _entry(
        pieces, pii_type, str(R.CONTEXTUAL_CONFIDENCE), R.LAYER_CONTEXTUAL, seq, "contextual", "uncertain"
    )


def spans_of(entries: list[Sql], at: Sql = "0") -> Sql:
    """The spans of the entries; all hits are placed by one shared step.  ``at`` is
    where the searched part begins in its text."""
    if not entries:
        return no_spans()

    def placed(e: Sql) -> Sql:
        def span(start: Sql, end: Sql, part: Sql) -> Sql:
            # only names have no confidence of their own
            confidence = f"coalesce({e}.confidence, {_name_confidence(part)})"
            return make_span(
                f"({at} + {start})", f"({at} + {end})", part, f"{e}.pii_type", f"{e}.priority",
                confidence, f"{e}.layer", f"{e}.seq", f"{e}.rule", f"{e}.status",
            )

        return place_pieces(f"{e}.pieces", span)

    found = keep(f"array({', '.join(entries)})", lambda e: f"{e}.pieces IS NOT NULL")
    return f"flatten({transform(found, placed)})"


def rule_spans(text: Sql, rule: R.Rule, threshold: float) -> Sql:
    return spans_of([rule_entry(text, rule, threshold)])


def learned_spans(
    text: Sql, pii: Iterable[tuple[str, str]], boundary: bool = False
) -> Sql:
    """Literal values, anywhere in the text, case-blind, always matches.

    Every value is tried on every text; :func:`dictionary.dictionary_spans`
    finds the same spans of a table of values by a join.
    """
    entries = [(known_type(t), v) for t, v in pii if v]
    if not entries:
        return no_spans()
    rows = [
        struct(
            seq=str(i),
            pii_type=text_literal(t),
            priority=str(R.TYPE_PRIORITY[t]),
            folded=fold_case(text_literal(v)),
            regex=text_literal(literal_regex(v, boundary)),
        )
        for i, (t, v) in enumerate(entries)
    ]

    def expand(entry: Sql) -> Sql:
        return transform(
            regex_hits(text, f"{entry}.regex"),
            lambda h: make_span(
                f"{h}.start", f"{h}.end", f"{h}.text", f"{entry}.pii_type",
                f"{entry}.priority", str(R.LEARNED_CONFIDENCE), R.LAYER_LEARNED,
                f"{entry}.seq", "'learned'", "'match'",
            ),
        )

    def search(folded: Sql) -> Sql:
        present = keep(
            f"array({', '.join(rows)})", lambda e: f"contains({folded}, {e}.folded)"
        )
        return f"flatten({transform(present, expand)})"

    return let(fold_case(text), search)


def drop_safe(spans: Sql, safe: Iterable[str]) -> Sql:
    """Drop hits whose lower text is known safe; learned values stay."""
    values = sorted({v.lower() for v in safe})
    if not values:
        return spans
    return keep(
        spans,
        lambda s: f"({s}.layer = {R.LAYER_LEARNED} "
        f"OR lower({s}.text) NOT IN ({text_list(values)}))",
    )


def name_spans(text: Sql) -> Sql:
    return spans_of([name_entry(text)])


def contextual_spans(text: Sql, pii_type: str, seq: int = 0) -> Sql:
    return spans_of([contextual_entry(text, pii_type, seq)])


def _layer_spans(
    text: Sql,
    parts: Sql | None,
    rules: Iterable[R.Rule],
    threshold: float,
    names: bool = False,
    contextual: tuple[str, ...] = (),
) -> Sql:
    """The spans of some layers: patterns that may be searched in windows in
    ``parts``, the text's windows (if given), and all others in the whole text."""
    rules = list(rules)
    inside = [r for r in rules if parts is not None and r.in_windows]
    whole = [rule_entry(text, r, threshold) for r in rules if r not in inside]
    if names and parts is None:
        whole.append(name_entry(text))
    whole += [contextual_entry(text, kind, seq) for seq, kind in enumerate(contextual)]
    if parts is None or not (inside or names):
        return spans_of(whole)

    def searched(w: Sql) -> Sql:
        body = f"{w}.body"
        entries = [rule_entry(body, r, threshold) for r in inside]
        return spans_of(entries + ([name_entry(body)] if names else []), f"{w}.at")

    found = [f"flatten({transform(parts, searched)})"]
    return concat(found + ([spans_of(whole)] if whole else []))


def raw_spans(
    text: Sql, detector: Detector, entities: Sql | None = None, parts: Sql | None = None
) -> Sql:
    """Spans of all layers before arbitration; ``parts`` are the text's windows, in
    which most patterns are searched if they are at hand."""
    learned = []
    if detector.learned_pii:
        learned.append(learned_spans(text, detector.learned_pii, detector.learned_boundary))
    rules = (*detector.rules, *detector.custom_patterns)
    late = (detector.names, detector.contextual)
    if entities is None:
        found = _layer_spans(text, parts, rules, detector.threshold, *late)
        return drop_safe(concat([*learned, found]), detector.learned_safe)
    # entities look at what the earlier layers have found
    early = _layer_spans(text, parts, rules, detector.threshold)
    found = let(
        drop_safe(concat([*learned, early]), detector.learned_safe),
        lambda earlier: concat(
            [earlier, entity_spans(text, entities, earlier, detector.threshold)]
        ),
    )
    last = _layer_spans(text, parts, (), detector.threshold, *late)
    return drop_safe(concat([found, last]), detector.learned_safe)


def detect_spans(
    text: Sql, detector: Detector, entities: Sql | None = None, parts: Sql | None = None
) -> Sql:
    """All claimed spans of a text, one per (start, end), sorted by start."""
    return first_claims(raw_spans(text, detector, entities, parts))
