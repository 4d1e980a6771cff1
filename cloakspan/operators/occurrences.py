"""Where the values of a table of any size stand in texts.

Values are filed under one short gram.  Each place of a text at which a filed gram
begins becomes a row with the characters around it; it meets the gram's values in
an equi-join, and each value is compared with the text at the place where it would have
to stand.  So a text costs its length and what it holds, not its length times
the values found in it.

* A text is cut into chunks with a margin on both sides, so every place has its
  surroundings and none is far from the start of its string.
* Values are filed by how often their grams occur in the texts, as far as a sample
  tells, then by how many values share the gram.  This decides the work and
  never the result.
* Values come in classes by their length; a class is one pass, and its longest
  value is the margin.
* Hits of one value do not overlap: as in a regex search, the first one counts.
  Only values that can overlap themselves are brought together for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitmap import Bitmap
from ..functions.expr import Sql, compute_once, exists, let, struct, text_literal, transform
from ..functions.staging import stage
from .detect import fold_case

UNIT = ["scope_id", "doc_id", "unit_no"]
GRAM = 5
#: Code points of a chunk, the longest value of the first class, and how much
#: longer those of the next one may be.
CHUNK, WIDTH, WIDER = 8192, 64, 16
#: Units that are looked at for the frequency of grams.
SAMPLE = 1_000

_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _expanding() -> tuple[str, str]:
    """Letters whose upper case is longer than they are, and a private stand-in
    for each that all its cases share."""
    longer = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
    base = {c: c.lower() if len(c.lower()) == 1 else c for c in longer}
    base |= {c: c.lower() for c in map(chr, range(0x10000)) if c.lower() in base}
    order = {x: i for i, x in enumerate(sorted(set(base.values())))}
    return "".join(base), "".join(chr(0xE000 + order[x]) for x in base.values())


_LONGER, _STAND_INS = _expanding()


def fold_in_place(text: Sql) -> Sql:
    """A coarse case fold with one code point for each of the text's: what is
    equal under case-blind matching folds alike.

    All code points beyond the basic plane fold to one, as a regex search steps
    through their halves.
    """
    flat = f"regexp_replace({text}, {text_literal(_ASTRAL)}, '\\uE7FF')"
    one = f"translate({flat}, {text_literal(_LONGER)}, {text_literal(_STAND_INS)})"

    def checked(x: Sql) -> Sql:
        single = transform(f"split({x}, '')", lambda c: f"if(length(upper({c})) = 1, {fold_case(c)}, {c})")
        return let(
            fold_case(x), lambda f: f"if(length({f}) = length({x}), {f}, array_join({single}, ''))"
        )

    return let(one, checked)


def keep_in_place(text: Sql) -> Sql:
    """The text as it is, but for code points beyond the basic plane."""
    return f"regexp_replace({text}, {text_literal(_ASTRAL)}, '\\uE7FF')"


def every_gram(folded: Sql, size: int) -> Sql:
    """The gram of ``size`` characters at every position, by one regex pass: a
    look-ahead captures the characters."""
    pattern = text_literal(f"(?s)(?=(.{{{size}}}))")
    return f"regexp_extract_all({folded}, {pattern}, 1)"


def _by_size(folded: Sql, size: int) -> Sql:
    arms = " ".join(f"WHEN {n} THEN {every_gram(folded, n)}" for n in range(1, size + 1))
    return f"CASE gram_size {arms} END"


def _frequencies(units: DataFrame, grams: DataFrame, fold, size: int) -> DataFrame:
    """How often each of ``grams`` occurs in a sample of the units."""
    share = max(1, units.count() // SAMPLE)
    some = units.where(F.pmod(F.xxhash64(*UNIT), F.lit(share)) == 0)
    chunks = some.select(F.expr(f"substr(text, 1, {CHUNK})").alias("body"))
    folded = compute_once(chunks, folded=fold("body")).where("folded IS NOT NULL")
    sizes = [r[0] for r in grams.select(F.length("gram")).distinct().collect()] or [size]
    cut = ", ".join(every_gram("folded", n) for n in sorted(sizes))
    held = folded.select(F.explode(F.expr(f"concat({cut})")).alias("gram")).groupBy("gram").count()
    return held.join(grams, "gram").select("gram", F.col("count").alias("seen"))


def file_by_texts(values: DataFrame, units: DataFrame, fold, size: int = GRAM) -> DataFrame:
    """``values`` (with ``folded``) and the ``gram`` they are filed under, which
    begins ``gram_at`` code points into the value."""
    sized = values.withColumn("gram_size", F.least(F.length("folded"), F.lit(size)))
    cut = sized.select("folded", F.expr(f"array_distinct({_by_size('folded', size)})").alias("cut"))
    exploded = stage(cut.distinct().select("folded", F.explode("cut").alias("gram")), "value-grams")
    shared = exploded.groupBy("gram").agg(F.count("*").alias("sharing"))
    seen = _frequencies(units, exploded.select("gram").distinct(), fold, size)
    rated = exploded.join(shared, "gram").join(seen, "gram", "left").fillna(0, ["seen"])
    chosen = rated.groupBy("folded").agg(
        F.min_by("gram", F.struct("seen", "sharing", "gram")).alias("gram")
    )
    return (
        sized.drop("gram_size")
        .join(chosen, "folded")
        .withColumn("gram_at", F.expr("locate(gram, folded) - 1"))
        .withColumn("len", F.length("folded"))
    )


def _places(units: DataFrame, filed: DataFrame, fold, width: int, chunk: int) -> DataFrame:
    """Rows (unit, ``gram``, ``at``, ``near``, ``near_at``): a filed gram at a code
    point of the text, the text around it and where that begins."""
    # at most as many rows as a gram has characters
    sizes = sorted(r[0] for r in filed.select(F.length("gram")).distinct().collect())
    known = Bitmap(filed.select(F.xxhash64("gram").alias("h")))
    numbered = units.select(
        *UNIT, "text", F.expr(f"explode(sequence(0, greatest(length(text) - 1, 0) div {chunk}))").alias("c")
    )
    begin = f"greatest(c * {chunk} - {width} - 1, 0)"
    cut = numbered.selectExpr(
        *UNIT, f"cast({begin} AS int) AS begin", f"cast(c * {chunk} AS int) AS own",
        f"substr(text, cast({begin} + 1 AS int), cast((c + 1) * {chunk} + {width} + 1 - {begin} AS int)) AS body",
    )
    folded = compute_once(cut, body_=struct(body="body", folded=fold("body"))).selectExpr(
        *UNIT, "begin", "own", "body_.body AS body", "body_.folded AS folded"
    )

    def hits(size: int) -> Sql:
        tested = transform(
            every_gram("folded", size),
            lambda g, i: f"if(begin + {i} >= own AND begin + {i} < own + {chunk} "
            f"AND {known.may_hold(f'xxhash64({g})')}, {struct(at=f'begin + {i}', gram=g)}, NULL)",
            arity=2,
        )
        return f"array_compact({tested})"

    if len(sizes) == 1:
        # grams become rows and are tested in the same step, by compiled code
        cut = F.posexplode(F.expr(every_gram("folded", sizes[0]))).alias("i", "gram")
        each = (
            folded.select(*UNIT, "begin", "own", "body", cut)
            .where(f"begin + i >= own AND begin + i < own + {chunk}")
            .where(known.may_hold("xxhash64(gram)"))
            .selectExpr(*UNIT, "begin", "body", "begin + i AS at", "gram")
        )
    else:
        found = [hits(n) for n in sizes] or ["cast(array() AS array<struct<at: int, gram: string>>)"]
        each = folded.select(
            *UNIT, "begin", "body", F.expr(f"inline(concat({', '.join(found)}))").alias("at", "gram")
        )
    near = f"greatest(at - {width} - 1, begin)"
    return each.selectExpr(
        *UNIT, "gram", "at", f"{near} AS near_at",
        f"substr(body, {near} - begin + 1, at - {near} + {width} + 1) AS near",
    )


def _first_ones(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of hits of one value that overlap the first, then the next behind it."""
    item = "struct<start: int, text: string>"
    hits = F.sort_array(F.collect_list(F.struct("start", "text"))).alias("hits")
    # kept hits go into sections, as appending copies an array
    chosen = f"""aggregate(hits,
      named_struct('last', 0, 'full', cast(array() AS array<array<{item}>>), 'part', cast(array() AS array<{item}>)),
      (s, x) -> if(x.start < s.last, s, named_struct(
        'last', x.start + len,
        'full', if(size(s.part) < 512, s.full, array_append(s.full, s.part)),
        'part', if(size(s.part) < 512, array_append(s.part, x), array(x)))),
      s -> flatten(array_append(s.full, s.part)))"""
    others = [c for c in columns if c not in ("start", "text")]
    return (
        rows.groupBy(*others, "len")
        .agg(hits)
        .select(*others, F.expr(f"inline({chosen})").alias("start", "text"))
        .select(columns)
    )


def _class_of(
    units: DataFrame, values: DataFrame, payload: list[str], on: list[str], case_blind: bool,
    boundary: bool, gram: int, width: int, chunk: int,
) -> DataFrame:
    fold = fold_in_place if case_blind else keep_in_place
    named = compute_once(values, folded=fold("value"))
    border = exists(
        "sequence(1, len - 1)", lambda k: f"substr(folded, {k} + 1) = substr(folded, 1, len - {k})"
    )
    filed = file_by_texts(named, units, fold, gram).withColumn(
        "tangled", F.expr(f"if(len > 1, {border}, false)")
    )
    filed = stage(filed, "filed-values")
    met = _places(units, filed, fold, width, chunk).join(filed, ["gram", *on])
    met = met.withColumn("skip", F.expr("at - gram_at - near_at")).where("skip >= 0")
    met = met.withColumn("hit", F.expr("substr(near, skip + 1, len)"))
    if case_blind:
        special = text_literal(r"([^\p{L}\p{N}_])")
        quoted = f"regexp_replace(value, {special}, {text_literal(chr(92) * 2 + '$1')})"
        same = f"(hit = value OR hit RLIKE concat({text_literal(r'(?iuU)\A')}, {quoted}, {text_literal(r'\z')}))"
        met = met.where(f"{fold('hit')} = folded AND {same}")
    else:
        met = met.where("hit = value")
    if boundary:
        word = text_literal(r"[\p{L}\p{N}_]")
        met = met.where(
            f"NOT (skip > 0 AND substr(near, skip, 1) RLIKE {word}) "
            f"AND NOT (substr(near, skip + len + 1, 1) RLIKE {word})"
        )
    columns = [*UNIT, "start", "text", "value", *payload]
    rows = met.withColumn("start", F.expr("at - gram_at")).withColumn("text", F.col("hit"))
    if filed.where("tangled").isEmpty():
        return rows.select(columns)  # the other branch would cut the texts again
    plain = rows.where("NOT tangled").select(columns)
    return plain.union(_first_ones(rows.where("tangled").select(*columns, "len"), columns))


def occurrences(
    units: DataFrame,
    values: DataFrame,
    payload: list[str],
    on: list[str] | None = None,
    case_blind: bool = True,
    boundary: bool = False,
    gram: int = GRAM,
    chunk: int = CHUNK,
    width: int = WIDTH,
) -> DataFrame:
    """Rows (unit, ``start``, ``text``, ``value``, payload) for each place where a
    value stands in a unit's text: case-blind or exactly, as a whole word with
    ``boundary``, each value on its own.

    ``values`` hold ``value`` (empty ones are ignored), ``payload`` columns and
    those of ``on``, which a unit must share; equal rows count once.
    """
    on = on or []
    wanted = values.where("length(value) > 0").select("value", *{**dict.fromkeys(payload), **dict.fromkeys(on)})
    wanted = stage(wanted.distinct(), "values")
    longest = wanted.agg(F.max(F.length("value"))).first()[0] or 0
    rows, least = None, 0
    while rows is None or least < longest:
        part = wanted.where(F.length("value").between(least + 1, width))
        if rows is None or not part.isEmpty():
            found = _class_of(units, part, payload, on, case_blind, boundary, gram, width, max(chunk, 4 * width))
            rows = found if rows is None else rows.union(found)
        least, width = width, width * WIDER
    return rows
