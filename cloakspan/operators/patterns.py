"""Custom patterns that are a table of any size.

A pattern is not tried on every text.  Its syntax tree shows literals of which each
of its hits must hold one; the pattern is filed under a gram of them that is rare in
the texts, like a value of a dictionary, and a text meets only the patterns whose
literal it holds.  Equal patterns are analysed and searched once.  The plan does not
depend on the number of patterns, and none is collected.

Patterns without such a literal (``\\d{4}-\\d{4}``, or syntax that is not understood
here) have to be tried on every text.  They come to the texts in blocks of
``BLOCK`` patterns, one pass a block.  So do all patterns of a table of at most
``FEW``: their literals are looked for in the text's row.

Literals are found on the pattern table only; texts never enter a Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _constants as C
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.bitmap import Bitmap
from ..functions.dealing import MOST_TASKS
from ..functions.expr import Sql, compute_once, empty, exists, is_blank, keep, struct, text_literal, transform
from ..functions.spans import make_span, priority_of, regex_hits
from ..functions.staging import stage
from .detect import SPAN_FIELDS, fold_case
from .dictionary import UNIT, known_types
from .numbering import number_rows
from .occurrences import file_by_texts

#: Patterns that one pass brings to the texts, and the patterns of a table none of
#: which is worth a join.
BLOCK, FEW = 256, 8
#: Patterns that one task analyses.
EACH_TASK = 10_000
#: Characters of the filed grams that are listed for a place, and their ranges beyond
#: those that the regex engine looks up in a table.
MOST_CHARS, MOST_RANGES = 512, 16

_GROUPS = (C.SUBPATTERN, C.ATOMIC_GROUP)
_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)
#: Match no characters, so literals beside them stay neighbours.
_WIDTHLESS = (C.AT, C.ASSERT, C.ASSERT_NOT)


def required_literals(pattern: str) -> list[str]:
    """Strings of which each hit of the pattern holds at least one (without regard
    to case); none if the pattern requires no literal or is not understood."""
    try:
        return _required(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return []


def _items(sequence: Iterable) -> Iterator[tuple]:
    for op, argument in sequence:
        if op in _GROUPS:
            yield from _items(argument[-1] if op is C.SUBPATTERN else argument)
        else:
            yield op, argument


def _required(sequence: Iterable) -> list[str]:
    options, run = [], ""
    for op, argument in _items(sequence):
        if op is C.LITERAL:
            run += chr(argument)
            continue
        if op in _WIDTHLESS:
            continue
        options.append([run])
        run = ""
        if op in _REPEATS and argument[0] > 0:
            options.append(_required(argument[-1]))
        elif op is C.BRANCH:
            arms = [_required(arm) for arm in argument[1]]
            options.append([x for arm in arms for x in arm] if all(arms) else [])
    options.append([run])
    usable = [sorted(set(o)) for o in options if o and all(o)]
    return max(usable, key=lambda o: (min(map(len, o)), -len(o)), default=[])


def _analysed(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for table in tables:
        table["regex"] = [R.java_regex(p, ignore_case=False) for p in table["pattern"]]
        table["literals"] = [required_literals(p) for p in table["pattern"]]
        yield table


def prepared_patterns(
    patterns: DataFrame, first_seq: int = 0, threshold: float = R.AUTO_THRESHOLD
) -> DataFrame:
    """Patterns in the order of their claims, with their Java ``regex`` and their
    ``literals``; rows without a pattern are left out.

    Equal patterns are analysed once, in tasks of like size.
    """
    given = patterns.where("pattern IS NOT NULL").select("name", "pattern", "pii_type", "confidence", "created_at")
    typed = number_rows(given, ["created_at", "name"], "n").selectExpr(
        f"cast(n - 1 + {first_seq} AS int) AS seq", "name", "pattern",
        f"{known_types('pii_type')} AS pii_type",
        f"coalesce(confidence, {R.CUSTOM_CONFIDENCE}) AS confidence",
    )
    distinct = stage(given.select("pattern").distinct(), "distinct-patterns")
    dealt = distinct.repartition(min(MOST_TASKS, distinct.count() // EACH_TASK + 1), "pattern")
    schema = "pattern string, regex string, literals array<string>"
    analysed = stage(dealt.mapInPandas(_analysed, schema), "analysed-patterns")
    status = f"if(confidence >= {threshold}, 'match', 'uncertain')"
    return stage(typed.join(analysed, "pattern").withColumn("status", F.expr(status)), "patterns")


_PAYLOAD = ["seq", "name", "pii_type", "confidence", "status", "regex"]


def _span(hit: Sql, entry: Sql) -> Sql:
    return make_span(
        f"{hit}.start", f"{hit}.end", f"{hit}.text", f"{entry}.pii_type", priority_of(f"{entry}.pii_type"),
        f"{entry}.confidence", R.LAYER_CUSTOM, f"{entry}.seq", f"{entry}.name", f"{entry}.status",
    )


def _found(entries: Sql, text: Sql) -> Sql:
    """Spans of all patterns in ``entries``."""

    def spans(e: Sql) -> Sql:
        return transform(regex_hits(text, f"{e}.regex"), lambda h: _span(h, e))

    return f"flatten({transform(entries, spans)})"


def _class(chars: list[str]) -> str:
    """A regex for one of ``chars``, as cheap as the engine has it; any character
    where it would be long, or there are none.

    Halves of characters beyond the basic plane are cut out as question marks, so
    these stand for any character too.
    """
    codes = sorted(map(ord, chars))
    if not codes or "?" in chars or codes[-1] > 0xFFFF:
        return "."
    listed = [f"\\x{c:02x}" for c in codes if c < 256]
    ranges: list[list[int]] = []
    for c in (c for c in codes if c >= 256):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    if len(ranges) > MOST_RANGES:
        return "."
    listed += [rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges]
    return f"[{''.join(listed)}]"


def _folded(text: Sql) -> Sql:
    """``fold_case``, which for ASCII is upper case."""
    return f"if(length({text}) = octet_length({text}), upper({text}), {fold_case(text)})"


def _like_grams(folded: Sql, filed: DataFrame) -> Sql:
    """All grams of a text that have at each place a character which a filed gram of
    their length has there, by one regex pass for each length.

    The driver gets at most ``MOST_CHARS`` characters for a place.
    """
    grams = filed.select("gram").distinct().withColumn("size", F.length("gram"))
    each = transform("sequence(1, size)", lambda i: struct(at=i, char=f"substr(gram, {i}, 1)"))
    chars = grams.select("size", F.expr(f"inline({each})")).distinct()
    some = F.when(F.count("*") <= MOST_CHARS, F.collect_list("char")).alias("chars")
    places = {(r["size"], r["at"]): r["chars"] for r in chars.groupBy("size", "at").agg(some).collect()}
    cut = []
    for size in sorted({size for size, _ in places}):
        pattern = "".join(_class(places[size, at] or []) for at in range(1, size + 1))
        cut.append(f"regexp_extract_all({folded}, {text_literal(f'(?s)(?=({pattern}))')}, 1)")
    return f"concat({', '.join(cut)})" if cut else empty("array<string>")


def _candidates(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """Per unit ``entries``: the filed literals whose gram occurs in the unit's text.

    Grams that no literal is filed under do not leave their step: they are cut out
    only where their characters fit, and a bitmap of the filed grams is tested there.
    """
    known = Bitmap(filed.select(F.xxhash64("gram").alias("h")))
    folded = compute_once(texts, _folded=_folded("text"))
    held = folded.select(*UNIT, F.explode(F.expr(_like_grams("_folded", filed))).alias("gram"))
    held = held.where(known.may_hold("xxhash64(gram)")).distinct()
    entry = F.struct("folded", "regex")
    return held.join(filed, "gram").groupBy(*UNIT).agg(F.collect_list(entry).alias("entries"))


def _filed_spans(units: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Spans of the patterns with a literal, in the texts that hold it.

    Equal patterns are searched once, and meet their names behind the search.
    """
    literals = known.select("regex", F.explode("literals").alias("literal"))
    literals = literals.select("regex", F.expr(fold_case("literal")).alias("folded")).distinct()
    filed = stage(file_by_texts(literals, units, fold_case).select("gram", "folded", "regex"), "filed-patterns")
    met = compute_once(texts.join(_candidates(texts, filed), UNIT), _folded=_folded("text"))
    holding = keep("entries", lambda e: f"contains(_folded, {e}.folded)")
    regexes = f"array_distinct({transform(holding, lambda e: f'{e}.regex')})"

    def hits(regex: Sql) -> Sql:
        return transform(regex_hits("text", regex), lambda h: struct(regex=regex, hit=h))

    found = met.select(*UNIT, F.expr(f"inline(flatten({transform(regexes, hits)}))"))
    entries = known.where("size(literals) > 0").select("regex", F.struct(*_PAYLOAD).alias("entry"))
    spans = found.join(entries, "regex")
    return spans.select(*UNIT, F.expr(f"inline(array({_span('hit', 'entry')}))").alias(*SPAN_FIELDS))


def pattern_spans(
    units: DataFrame,
    patterns: DataFrame,
    first_seq: int = 0,
    threshold: float = R.AUTO_THRESHOLD,
    block: int = BLOCK,
    few: int = FEW,
) -> DataFrame:
    """Raw spans of ``patterns`` (``name, pattern, pii_type, confidence,
    created_at``) in ``units``.  Texts of white space have none.

    Only texts that hold a pattern's literal shuffle, to meet their patterns.
    """
    texts = units.where(f"NOT ({is_blank('text')})").select(*UNIT, "text")
    known = prepared_patterns(patterns, first_seq, threshold)
    filed = known.count() > few
    others = known.where("size(literals) = 0") if filed else known
    folded = F.expr(transform("literals", fold_case)).alias("folded")
    others = number_rows(others.select(*_PAYLOAD, folded), ["seq"], "place")
    others = others.withColumn("block", F.expr(f"(place - 1) div {block}"))
    entry = F.struct(*_PAYLOAD, "folded")
    blocks = stage(
        others.groupBy("block").agg(F.sort_array(F.collect_list(entry)).alias("entries")), "unfiled-patterns"
    )
    rows = _filed_spans(units, texts, known) if filed else None
    texts = compute_once(texts, _folded=fold_case("text"))
    for number in range(max(0 if filed else 1, blocks.count())):
        # one row of at most `block` patterns
        one = F.broadcast(blocks.where(F.col("block") == number).select("entries"))
        holding = keep(
            "entries",
            lambda e: f"size({e}.folded) = 0 OR {exists(f'{e}.folded', lambda x: f'contains(_folded, {x})')}",
        )
        tried = compute_once(texts.crossJoin(one), _held=holding)
        spans = F.expr(f"inline({_found('_held', 'text')})").alias(*SPAN_FIELDS)
        tried = tried.select(*UNIT, spans)
        rows = tried if rows is None else rows.union(tried)
    return rows
