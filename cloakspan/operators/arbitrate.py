"""Span arbitration inside one text's array: claims, status, overlaps.

The arrays are bounded by the text they came from.  Overlap resolution first
cuts the sorted spans into clusters that touch, so the greedy step only
compares spans of one cluster.
"""

from __future__ import annotations

from .. import rules as R
from ..functions.expr import Sql, exists, fold, keep, let, running, struct, transform
from ..functions.spans import no_spans


def status_of(layer: int, confidence: float, threshold: float) -> str:
    if layer == R.LAYER_LEARNED:
        return "match"
    if layer >= R.LAYER_NAMES:
        return "uncertain"
    return "match" if confidence >= threshold else "uncertain"


def first_claims(spans: Sql) -> Sql:
    """Keep the first claim of each (start, end), by layer then rule order."""

    def firsts(ordered: Sql) -> Sql:
        def is_first(span: Sql, i: Sql) -> Sql:
            before = f"get({ordered}, {i} - 1)"
            return (
                f"({i} = 0 OR {before}.start != {span}.start "
                f"OR {before}.end != {span}.end)"
            )

        return keep(ordered, is_first, arity=2)

    return let(f"array_sort({spans})", firsts)


def of_status(spans: Sql, status: str) -> Sql:
    return keep(spans, lambda s: f"{s}.status = '{status}'")


def _rank(span: Sql, order: str) -> dict[str, Sql]:
    """Sort key of the greedy choice; the field order is the policy."""
    confidence = f"-{span}.confidence"
    priority = f"-{span}.priority"
    length = f"length({span}.text)"
    if order == "reference":
        head = [confidence, priority, length]
    elif order == "longest":
        head = [f"-{length}", confidence, priority, f"{span}.start"]
    else:
        raise ValueError(f"unknown order policy: {order}")
    parts = [*head, f"{span}.layer", f"{span}.seq", f"{span}.start", f"{span}.end"]
    return {f"k{i}": part for i, part in enumerate(parts)}


def _ranked(spans: Sql, order: str) -> Sql:
    keyed = transform(spans, lambda s: struct(**_rank(s, order), span=s))
    return transform(f"array_sort({keyed})", lambda k: f"{k}.span")


def _greedy(spans: Sql, order: str, same_text: bool) -> Sql:
    def step(kept: Sql, span: Sql) -> Sql:
        def clash(k: Sql) -> Sql:
            test = f"({span}.end > {k}.start AND {span}.start < {k}.end)"
            return f"({test} OR {span}.text = {k}.text)" if same_text else test

        return f"if({exists(kept, clash)}, {kept}, concat({kept}, array({span})))"

    return fold(_ranked(spans, order), no_spans(), step)


def _clusters(ordered: Sql) -> Sql:
    """Cut spans sorted by start into runs that overlap: a run begins where a
    span starts after all earlier ones have ended."""
    reach = running(
        transform(ordered, lambda s: f"{s}.end"),
        lambda a, b: f"greatest({a}, {b})",
        "-1",
    )

    def cut(reached: Sql) -> Sql:
        begins = keep(
            f"sequence(0, size({ordered}) - 1)",
            lambda i: f"({i} = 0 OR get({ordered}, {i}).start >= get({reached}, {i} - 1))",
        )
        return let(
            begins,
            lambda at: transform(
                at,
                lambda b, k: f"slice({ordered}, {b} + 1, "
                f"coalesce(get({at}, {k} + 1), size({ordered})) - {b})",
                arity=2,
            ),
        )

    return let(reach, cut)


def _touching(ordered: Sql) -> Sql:
    """True if any span starts before the one in front of it has ended."""
    return exists(
        f"sequence(0, size({ordered}) - 1)",
        lambda i: f"coalesce(get({ordered}, {i}).start "
        f"< get({ordered}, {i} - 1).end, false)",
    )


def _first_per_text(spans: Sql, order: str) -> Sql:
    """Of spans with the same text keep the best ranked one."""
    keyed = transform(
        spans, lambda s: struct(text=f"{s}.text", **_rank(s, order), span=s)
    )

    def firsts(ordered: Sql) -> Sql:
        kept = keep(
            ordered,
            lambda k, i: f"({i} = 0 OR get({ordered}, {i} - 1).text != {k}.text)",
            arity=2,
        )
        return transform(kept, lambda k: f"{k}.span")

    return let(f"array_sort({keyed})", firsts)


def resolve_overlaps(
    spans: Sql, order: str = "longest", repeats: str = "all"
) -> Sql:
    """Greedy choice among overlapping spans; result sorted by start.

    ``order``: ``longest`` (a containing span wins) or ``reference``
    (confidence, type priority, then the shorter span).  ``repeats``: ``all``
    keeps every occurrence of a value, ``first`` one span per exact text.
    """
    if repeats not in ("all", "first"):
        raise ValueError(f"unknown repeat policy: {repeats}")

    def resolve(ordered: Sql) -> Sql:
        if repeats == "all":
            grouped = transform(
                _clusters(ordered),
                lambda g: f"if(size({g}) < 2, {g}, {_greedy(g, order, False)})",
            )
            chosen, plain = f"flatten({grouped})", ordered
        else:
            chosen = _greedy(ordered, order, same_text=True)
            plain = f"array_sort({_first_per_text(ordered, order)})"
        return (
            f"CASE WHEN size({ordered}) < 2 THEN {ordered} "
            f"WHEN {_touching(ordered)} THEN array_sort({chosen}) "
            f"ELSE {plain} END"
        )

    return let(f"array_sort({spans})", resolve)


def arbitrate(claimed: Sql, order: str = "longest", repeats: str = "all") -> Sql:
    """Resolve matches and uncertain spans apart and return both, by start."""

    def both(c: Sql) -> Sql:
        matches = resolve_overlaps(of_status(c, "match"), order, repeats)
        uncertain = resolve_overlaps(of_status(c, "uncertain"), order, repeats)
        return f"array_sort(concat({matches}, {uncertain}))"

    return let(claimed, both)
