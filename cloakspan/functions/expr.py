"""Spark SQL expression text.

The operators describe a text's work as one Spark SQL expression.  They are
written as SQL fragments (``str``) and reach a DataFrame through ``F.expr``:
Spark parses a whole fragment in one go, where the same tree built from Column
calls costs thousands of round trips to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Sql = str

_names = count()


def text_literal(value: str) -> Sql:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_list(values: Iterable[str]) -> Sql:
    return ", ".join(text_literal(v) for v in values)


def fn(body: Callable[..., Sql], arity: int = 1) -> Sql:
    """A lambda with fresh variable names."""
    names = [f"v{next(_names)}" for _ in range(arity)]
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression that is named twice inside a higher-order function is
    otherwise computed again for every array element.
    """
    return f"element_at(transform(array({value}), {fn(body)}), 1)"


def struct(**fields: Sql) -> Sql:
    inside = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"named_struct({inside})"


def transform(array: Sql, body: Callable[..., Sql], arity: int = 1) -> Sql:
    return f"transform({array}, {fn(body, arity)})"


def keep(array: Sql, body: Callable[..., Sql], arity: int = 1) -> Sql:
    return f"filter({array}, {fn(body, arity)})"


def exists(array: Sql, body: Callable[[Sql], Sql]) -> Sql:
    return f"exists({array}, {fn(body)})"


def fold(
    array: Sql,
    start: Sql,
    step: Callable[[Sql, Sql], Sql],
    finish: Callable[[Sql], Sql] | None = None,
) -> Sql:
    tail = f", {fn(finish)}" if finish else ""
    return f"aggregate({array}, {start}, {fn(step, 2)}{tail})"


def running(
    values: Sql, combine: Callable[[Sql, Sql], Sql], start: Sql, levels: int = 3
) -> Sql:
    """For each element, ``combine`` over all elements up to it.

    ``combine`` is associative and ``start`` its neutral value.  Blocks of
    elements are folded first, then the blocks' results, so a long array costs
    little more per element than a short one.
    """
    width = 32

    def upto(block: Sql, base: Sql) -> Sql:
        return transform(
            block,
            lambda _, i: fold(f"slice({block}, 1, {i} + 1)", base, combine),
            arity=2,
        )

    def blocked(array: Sql) -> Sql:
        blocks = transform(
            f"sequence(0, (size({array}) - 1) div {width})",
            lambda b: f"slice({array}, cast({b} * {width} + 1 AS int), {width})",
        )

        def joined(parts: Sql) -> Sql:
            results = transform(parts, lambda x: fold(x, start, combine))
            reached = running(results, combine, start, levels - 1)

            def offset(bases: Sql) -> Sql:
                each = transform(
                    parts,
                    lambda x, b: let(
                        f"if({b} = 0, {start}, get({bases}, {b} - 1))",
                        lambda base: upto(x, base),
                    ),
                    arity=2,
                )
                return f"flatten({each})"

            return let(reached, offset)

        return let(blocks, joined)

    def choose(array: Sql) -> Sql:
        if levels == 1:
            return upto(array, start)
        return (
            f"CASE WHEN size({array}) <= {width} THEN {upto(array, start)} "
            f"ELSE {blocked(array)} END"
        )

    return let(values, choose)


def running_totals(values: Sql) -> Sql:
    """The sum of the elements (longs) up to each one."""
    return running(values, lambda a, b: f"({a} + {b})", "0L")


def empty(ddl: str) -> Sql:
    return f"cast(array() AS {ddl})"


def concat(arrays: list[Sql]) -> Sql:
    return arrays[0] if len(arrays) == 1 else f"concat({', '.join(arrays)})"


def case(subject: Sql, values: dict[str, Sql], default: Sql = "NULL") -> Sql:
    arms = " ".join(
        f"WHEN {text_literal(name)} THEN {value}" for name, value in values.items()
    )
    return f"CASE {subject} {arms} ELSE {default} END"


def column(value: Sql) -> Column:
    return F.expr(value)


def compute_once(df: DataFrame, **columns: Sql) -> DataFrame:
    """Add columns behind a generator, so later filters and projections read
    the finished values instead of pulling the expressions in a second time."""
    return df.select("*", F.expr(f"inline(array({struct(**columns)}))"))


def is_blank(text: Sql) -> Sql:
    """True where the text holds nothing but white space."""
    pattern = text_literal(r"(?U)[^\s\x1c-\x1f]")
    return f"NOT {text} RLIKE {pattern}"


def strip(text: Sql) -> Sql:
    pattern = text_literal(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z")
    return f"regexp_replace({text}, {pattern}, '')"
