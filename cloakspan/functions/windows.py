"""The parts of a text in which built-in patterns and placeholders can stand.

A token is a run of characters without white space.  A window is a token that holds
a digit, an ``@`` or a colon, or a run of two or more tokens that each hold one of
these or a capital letter, taken as long as it goes.  One pass finds the windows of
a text, and the patterns search only these.

A pattern may be searched in windows if each of its hits lies in tokens of this kind
and its look-arounds read no further than white space.  Then the hits in a window
are those in the text: white space or an end of the text borders each window.
"""

from __future__ import annotations

from string import ascii_uppercase, digits

from .expr import Sql, empty, let, running_totals, struct, text_literal, transform

WINDOW_ARRAY = "array<struct<at:int,body:string>>"

_CAPITALS = "А-ЯҐЄІЇ"  # beside A-Z, those of the name pattern
_ASCII_SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"


def _listed(chars: str) -> str:
    """Single characters of a class, which the regex engine looks up in a table."""
    return "".join(f"\\x{ord(c):02x}" for c in chars)


def _window_regex() -> str:
    """Groups: what is left out, then the window behind it.

    All loops are possessive and each match begins where the last one ended, so a
    character is read a bounded number of times.
    """
    marks = "@:" + digits
    others = "".join(c for c in map(chr, range(128)) if c not in _ASCII_SPACE + marks + ascii_uppercase)
    ascii_rest = others + marks + ascii_uppercase
    space = r"[\s\x1c-\x1f]"
    token = rf"(?:[{_listed(ascii_rest)}]++|[^\x00-\x7f\s]++)"
    plain = rf"(?:[{_listed(others)}]++|[^\x00-\x7f\s\d{_CAPITALS}]++)"
    unmarked = rf"(?:[{_listed(others + ascii_uppercase)}]++|[^\x00-\x7f\s\d]++)"
    capital = rf"[{_listed(ascii_uppercase)}{_CAPITALS}]"
    special = rf"{plain}*+[{_listed(marks + ascii_uppercase)}\d{_CAPITALS}]"
    ends = rf"(?={space}|\z)"
    # whole plain tokens and what is behind them, by one look at a character
    fast = f"(?>[{_listed(others + _ASCII_SPACE)}]*[{_listed(_ASCII_SPACE)}])"
    # a lone token with capitals
    alone = rf"{plain}*+{capital}{unmarked}*+{ends}(?!{space}++{special})"
    left_out = rf"(?:{fast}|{space}++|{plain}++{ends}|{alone})*+"
    window = rf"{special}{token}*+(?:{space}++{special}{token}*+)*+"
    return rf"(?U)\G({left_out})({window})"


def window_bodies(text: Sql) -> Sql:
    """The windows of a text, without their places; none for null."""
    return f"regexp_extract_all(coalesce({text}, ''), {text_literal(_window_regex())}, 2)"


def in_one_text(bodies: Sql) -> Sql:
    """One text of windows, between which no pattern that may be searched in them hits:
    none crosses a plain token."""
    return f"array_join({bodies}, ' \\u0001 ')"


def windows(text: Sql) -> Sql:
    """The windows of a text, each with the code points in front of it; none for null."""
    gaps = f"regexp_extract_all(coalesce({text}, ''), {text_literal(_window_regex())}, 1)"
    parts = struct(gaps=gaps, bodies=window_bodies(text))

    def place(p: Sql) -> Sql:
        lens = transform(
            f"{p}.bodies",
            lambda b, i: f"cast(length(get({p}.gaps, {i})) + length({b}) AS bigint)",
            arity=2,
        )

        def at(ends: Sql) -> Sql:
            return transform(
                f"{p}.bodies",
                lambda b, i: struct(at=f"cast(get({ends}, {i}) AS int) - length({b})", body=b),
                arity=2,
            )

        return f"if(size({p}.bodies) = 0, {empty(WINDOW_ARRAY)}, {let(running_totals(lens), at)})"

    return let(parts, place)
