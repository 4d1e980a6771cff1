"""Offsets, context and splicing as pure Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Callable

from ..rules import CONTEXT_CHARS, TYPE_PRIORITY
from ..schemas import HIT_ARRAY, SPAN_ARRAY
from .expr import (
    Sql,
    case,
    empty,
    exists,
    fold,
    keep,
    let,
    running_totals,
    struct,
    text_literal,
    transform,
)


# A noncharacter that valid text never holds; it fences the hits of one pass.
FENCE = "\ufdd0"


def _pieces(count: Sql, gap: Callable[[Sql], Sql], hit: Callable[[Sql], Sql], parts: Sql) -> Sql:
    """The lengths of gaps with the hit behind each, and the hits' parts."""
    lens = transform(
        f"sequence(0, {count} - 1)",
        lambda i: f"cast(length({gap(i)}) + length({hit(i)}) AS bigint)",
    )
    return struct(lens=lens, parts=parts)


def _fenced_pieces(text: Sql, regex: Sql, group: int) -> Sql:
    """Pieces of one regex pass: fence every hit, then cut at the fences, which
    leaves gap, hit, gap, hit ... gap."""
    fence = text_literal(FENCE)

    def cut(pieces: Sql) -> Sql:
        def hit(i: Sql) -> Sql:
            return f"get({pieces}, 2 * {i} + 1)"

        count = f"(size({pieces}) div 2)"
        parts = transform(f"sequence(0, cast({count} AS int) - 1)", hit)
        if group:
            parts = transform(parts, lambda h: f"regexp_extract({h}, {regex}, {group})")
        return _pieces(f"cast({count} AS int)", lambda i: f"get({pieces}, 2 * {i})", hit, parts)

    replacement = text_literal(f"{FENCE}$0{FENCE}")
    return let(
        f"regexp_replace({text}, {regex}, {replacement})",
        lambda marked: f"CASE WHEN contains({marked}, {fence}) "
        f"THEN {let(f'split({marked}, {fence}, -1)', cut)} END",
    )


def _two_pass_pieces(text: Sql, regex: Sql, group: int) -> Sql:
    """Pieces of two regex passes, for text that holds the fence."""

    def place(found: Sql) -> Sql:
        def cut(gaps: Sql) -> Sql:
            parts = f"regexp_extract_all({text}, {regex}, {group})" if group else found
            failed = "raise_error('a pattern matches the empty string')"
            count = f"if(size({gaps}) = size({found}) + 1, size({found}), cast({failed} AS int))"
            return _pieces(count, lambda i: f"get({gaps}, {i})", lambda i: f"get({found}, {i})", parts)

        return f"CASE WHEN size({found}) > 0 THEN {let(f'split({text}, {regex}, -1)', cut)} END"

    return let(f"regexp_extract_all({text}, {regex}, 0)", place)


def hit_pieces(text: Sql, regex: Sql, group: int = 0) -> Sql:
    """What :func:`place_pieces` needs to place the hits of ``regex``; null where
    there are none.

    With ``group`` the hits are those of that group, which has to sit at the
    end of the whole hit; the pattern has to match a whole hit on its own as it does
    in the text.
    """
    return (
        f"CASE WHEN contains({text}, {text_literal(FENCE)}) "
        f"THEN {_two_pass_pieces(text, regex, group)} "
        f"ELSE {_fenced_pieces(text, regex, group)} END"
    )


def place_pieces(pieces: Sql, make: Callable[[Sql, Sql, Sql], Sql]) -> Sql:
    """``make(start, end, text)`` for every hit, with code-point offsets: the
    running length of gaps and hits is where a hit ends.

    This is the bulk of an expression; place the pieces of several patterns by
    one call, inside a ``transform`` over them.
    """

    def place(ends: Sql) -> Sql:
        def found(part: Sql, i: Sql) -> Sql:
            return let(
                f"cast(get({ends}, {i}) AS int)",
                lambda end: make(f"({end} - length({part}))", end, part),
            )

        return transform(f"{pieces}.parts", found, arity=2)

    return let(running_totals(f"{pieces}.lens"), place)


def regex_hits(text: Sql, regex: Sql, group: int = 0) -> Sql:
    """All non-overlapping hits of ``regex`` with code-point offsets, or those of
    a ``group`` at the end of the hits."""

    def hits(pieces: Sql) -> Sql:
        placed = place_pieces(pieces, lambda start, end, part: struct(start=start, end=end, text=part))
        return f"CASE WHEN {pieces} IS NULL THEN {empty(HIT_ARRAY)} ELSE {placed} END"

    return let(hit_pieces(text, regex, group), hits)


def priority_of(pii_type: Sql) -> Sql:
    return case(pii_type, {k: str(v) for k, v in TYPE_PRIORITY.items()}, "0")


def make_span(
    start: Sql,
    end: Sql,
    text: Sql,
    pii_type: Sql,
    priority: Sql,
    confidence: Sql,
    layer: int | Sql,
    seq: Sql,
    rule: Sql,
    status: Sql,
) -> Sql:
    """One span; the field order is that of ``schemas.SPAN_STRUCT``."""
    return struct(
        start=start,
        end=end,
        layer=str(layer),
        seq=seq,
        text=text,
        pii_type=pii_type,
        confidence=f"cast({confidence} AS double)",
        priority=priority,
        rule=rule,
        status=status,
    )


def no_spans() -> Sql:
    return empty(SPAN_ARRAY)


def context_of(text: Sql, start: Sql, end: Sql, width: int = CONTEXT_CHARS) -> Sql:
    """The text around a span, with ``...`` where it is cut."""
    left = f"greatest({start} - {width}, 0)"
    right = f"least({end} + {width}, length({text}))"
    return (
        f"concat(if({left} > 0, '...', ''), "
        f"substr({text}, {left} + 1, {right} - {left}), "
        f"if({right} < length({text}), '...', ''))"
    )


def splice(text: Sql, edits: Sql) -> Sql:
    """Replace non-overlapping ``edits`` (sorted by start) in one pass.

    ``edits`` is an array of structs with ``start, end, placeholder``.  Long
    arrays are put in section by section, as finding a place in a text takes as
    long as the text in front of it.
    """
    width = 128

    def joined(body: Sql, items: Sql, begin: Sql) -> Sql:
        """``body``, which starts at ``begin``, up to the last edit's end."""

        def piece(edit: Sql, i: Sql) -> Sql:
            before = f"coalesce(get({items}, {i} - 1).end, {begin})"
            return (
                f"concat(substr({body}, {before} - {begin} + 1, {edit}.start - {before}), "
                f"{edit}.placeholder)"
            )

        return f"array_join({transform(items, piece, arity=2)}, '')"

    def sections(items: Sql) -> Sql:
        def section(g: Sql) -> Sql:
            part = f"slice({items}, {g} * {width} + 1, {width})"
            begin = f"coalesce(get({items}, {g} * {width} - 1).end, 0)"
            stop = f"get({items}, least(({g} + 1) * {width}, size({items})) - 1).end"
            body = f"substr({text}, {begin} + 1, {stop} - {begin})"
            return let(
                struct(part=part, begin=begin, body=body),
                lambda x: joined(f"{x}.body", f"{x}.part", f"{x}.begin"),
            )

        count = f"cast((size({items}) - 1) div {width} AS int)"
        return f"array_join({transform(f'sequence(0, {count})', section)}, '')"

    def join(items: Sql) -> Sql:
        tail = f"substr({text}, get({items}, size({items}) - 1).end + 1)"
        return (
            f"CASE WHEN size({items}) = 0 THEN {text} "
            f"WHEN size({items}) <= {width} THEN concat({joined(text, items, '0')}, {tail}) "
            f"ELSE concat({sections(items)}, {tail}) END"
        )

    return let(edits, join)


def splice_from_right(text: Sql, edits: Sql) -> Sql:
    """Replace edits, given by their last start first, one after the other on
    the changing text.  Overlapping edits cut into each other, as in the
    compatibility mode's source behaviour; others are put in by one pass."""

    def step(out: Sql, edit: Sql) -> Sql:
        return (
            f"concat(substr({out}, 1, {edit}.start), {edit}.placeholder, "
            f"substr({out}, {edit}.end + 1))"
        )

    def choose(items: Sql) -> Sql:
        cut = exists(
            f"sequence(1, greatest(size({items}) - 1, 1))",
            lambda i: f"coalesce(get({items}, {i}).end > get({items}, {i} - 1).start, false)",
        )
        return (
            f"CASE WHEN {cut} THEN {fold(items, text, step)} "
            f"ELSE {splice(text, f'reverse({items})')} END"
        )

    return let(edits, choose)


def count_by_type(spans: Sql) -> Sql:
    """``map<type, count>`` of an array of spans."""

    def entries(kinds: Sql) -> Sql:
        each = transform(
            f"array_sort(array_distinct({kinds}))",
            lambda kind: struct(
                key=kind,
                value=f"cast(size({keep(kinds, lambda k: f'{k} = {kind}')}) AS bigint)",
            ),
        )
        return f"map_from_entries({each})"

    return let(transform(spans, lambda s: f"{s}.pii_type"), entries)
