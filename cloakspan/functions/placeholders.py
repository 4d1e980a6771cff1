"""Placeholder text: rendering a number, and finding placeholders again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from ..rules import PLACEHOLDER_LISTS, PLACEHOLDER_TEMPLATES
from .expr import (
    Sql,
    case,
    keep,
    let,
    running_totals,
    struct,
    text_list,
    text_literal,
    transform,
)
from .windows import in_one_text, window_bodies

_FIELD = re.compile(r"\{n(?::0(\d)d)?\}")


def _printf(template: str) -> str:
    return _FIELD.sub(lambda m: f"%0{m[1]}d" if m[1] else "%d", template)


def render_placeholder(pii_type: Sql, n: Sql) -> Sql:
    """Placeholder of the ``n``-th value (from 1) of a type."""
    texts = {}
    for name, template in PLACEHOLDER_TEMPLATES.items():
        text = f"format_string({text_literal(_printf(template))}, {n})"
        if name in PLACEHOLDER_LISTS:
            words = f"array({text_list(PLACEHOLDER_LISTS[name])})"
            text = f"coalesce(get({words}, cast({n} - 1 AS int)), {text})"
        texts[name] = text
    return case(pii_type, texts, texts["custom"])


def placeholder_regex(custom: Iterable[str] = ()) -> str:
    """One pattern for every generated placeholder, longest literals first.

    A placeholder number is read to its last digit, so ``@user10`` is never
    taken for ``@user1``.  One look at a character leaves most positions of a
    text, and the alternatives are grouped by the kind of their first character.
    """
    literals = [w for words in PLACEHOLDER_LISTS.values() for w in words]
    literals = sorted({*literals, *(c for c in custom if c)}, key=lambda w: (-len(w), w))
    groups: dict[str, list[str]] = {}

    def add(first: str, part: str) -> None:
        if first.isascii() and first.isupper():
            kind = "[A-Z]"
        elif first.isascii() and first.isdigit():
            kind = "[0-9]"
        else:
            kind = first if first.isalnum() else "\\" + first
        groups.setdefault(kind, []).append(part)

    for word in literals:
        add(word[0], re.escape(word))
    for template in PLACEHOLDER_TEMPLATES.values():
        field = _FIELD.search(template)
        width = f"{{{field[1]},}}" if field[1] else "+"
        head, tail = template[: field.start()], template[field.end():]
        digits = "[0-9]" + width
        if not head:
            digits = "(?<![0-9])" + digits
        if not tail:
            digits += "(?![0-9])"
        add(head[:1] or "0", re.escape(head) + digits + re.escape(tail))
    firsts = "".join(kind.strip("[]") if len(kind) > 2 else kind for kind in groups)
    choices = "|".join(
        f"(?={kind})(?:{'|'.join(parts)})" for kind, parts in groups.items()
    )
    return f"(?=[{firsts}])(?:{choices})"


def taken_numbers(text: Sql, parts: Sql | None = None) -> Sql:
    """The generated placeholders that stand in a text, as a sorted array of
    ``struct<kind, n>``; these numbers must not be given out for it.  ``parts`` are
    the text's windows, if they are at hand."""

    def numbers(hit: Sql) -> Sql:
        found = []
        for name, template in PLACEHOLDER_TEMPLATES.items():
            field = _FIELD.search(template)
            head, tail = template[: field.start()], template[field.end() :]
            pattern = text_literal(f"\\A{re.escape(head)}([0-9]+){re.escape(tail)}\\z")
            n = f"try_cast(regexp_extract({hit}, {pattern}, 1) AS bigint)"
            # a cheap look first: most templates do not fit
            fits = f"startswith({hit}, {text_literal(head)}) AND endswith({hit}, {text_literal(tail)})"
            if name in PLACEHOLDER_LISTS:
                listed = text_list(PLACEHOLDER_LISTS[name])
                n = f"coalesce(nullif(array_position(array({listed}), {hit}), 0L), {n})"
                fits = f"({fits} OR {hit} IN ({listed}))"
            kind = text_literal(name)
            number = let(
                n,
                lambda v, kind=kind: f"if({render_placeholder(kind, v)} = {hit}, "
                f"{struct(kind=kind, n=v)}, NULL)",
            )
            found.append(f"CASE WHEN {fits} THEN {number} END")
        return f"array_compact(array({', '.join(found)}))"

    regex = text_literal(placeholder_regex())
    bodies = window_bodies(text) if parts is None else f"{parts}.body"
    hits = f"array_distinct(regexp_extract_all({in_one_text(bodies)}, {regex}, 0))"
    return f"array_sort(flatten({transform(hits, numbers)}))"


def around_taken(n: Sql, kind: Sql, taken: Sql) -> Sql:
    """``n`` moved up by the taken numbers of its type, t0 < t1 < ..., for which
    t_i - i <= n."""
    own = keep(taken, lambda t: f"{t}.kind = {kind}")
    lowered = transform(own, lambda t, i: f"{t}.n - {i}", arity=2)
    moved = f"size({keep(lowered, lambda a: f'{a} <= {n}')})"
    return f"if(size({taken}) = 0, {n}, {n} + {moved})"


def number_in_row(ordered: Sql, taken: Sql | None = None) -> Sql:
    """Number the values of one text's spans, given in numbering order.

    Equal (type, lower-cased text) share a number; every type counts from 1 and
    leaves the numbers in ``taken`` out.  Returns the spans with ``value_lc``,
    ``n`` and ``placeholder`` added.  Sorts take the place of searches, so long
    arrays cost little more per span.
    """

    def first_of_run(items: Sql, *fields: str) -> Callable[[Sql, Sql], Sql]:
        """Whether an item differs from the one before in one of the fields."""

        def differs(item: Sql, i: Sql) -> Sql:
            tests = " OR ".join(
                f"get({items}, {i} - 1).{f} != {item}.{f}" for f in fields
            )
            return f"({i} = 0 OR {tests})"

        return differs

    def numbers(keyed: Sql) -> Sql:
        """The number of each span, from spans sorted by type, value, place."""
        is_first = first_of_run(keyed, "kind", "value")
        flags = transform(keyed, lambda k, j: f"if({is_first(k, j)}, 1L, 0L)", arity=2)

        def ranked(runs: Sql) -> Sql:
            # the first place of each value, sorted by type and place
            places = transform(
                keep(keyed, is_first, arity=2),
                lambda k, j: struct(kind=f"{k}.kind", place=f"{k}.place", run=j),
                arity=2,
            )

            def by_run(sorted_places: Sql) -> Sql:
                kinds = transform(sorted_places, lambda x: f"{x}.kind")
                return let(
                    kinds,
                    lambda names: transform(
                        "array_sort({})".format(
                            transform(
                                sorted_places,
                                lambda x, at: struct(
                                    run=f"{x}.run",
                                    n=f"{at} + 2 - array_position({names}, {x}.kind)",
                                ),
                                arity=2,
                            )
                        ),
                        lambda x: f"{x}.n",
                    ),
                )

            def spread(counted: Sql) -> Sql:
                each = transform(
                    keyed,
                    lambda k, j: struct(
                        place=f"{k}.place",
                        n=f"get({counted}, cast(get({runs}, {j}) - 1 AS int))",
                    ),
                    arity=2,
                )
                return transform(f"array_sort({each})", lambda x: f"{x}.n")

            return let(let(f"array_sort({places})", by_run), spread)

        return let(running_totals(flags), ranked)

    def body(spans: Sql) -> Sql:
        keyed = transform(
            spans,
            lambda s, i: struct(kind=f"{s}.pii_type", value=f"lower({s}.text)", place=i),
            arity=2,
        )

        def numbered(found: Sql) -> Sql:
            def one(span: Sql, i: Sql) -> Sql:
                n = f"cast(get({found}, {i}) AS bigint)"
                if taken is not None:
                    n = let(n, lambda v: around_taken(v, f"{span}.pii_type", taken))
                return let(
                    n,
                    lambda n: struct(
                        start=f"{span}.start",
                        end=f"{span}.end",
                        text=f"{span}.text",
                        pii_type=f"{span}.pii_type",
                        value_lc=f"lower({span}.text)",
                        n=n,
                        placeholder=render_placeholder(f"{span}.pii_type", n),
                        status=f"{span}.status",
                    ),
                )

            return transform(spans, one, arity=2)

        return let(let(f"array_sort({keyed})", numbers), numbered)

    return let(ordered, body)
