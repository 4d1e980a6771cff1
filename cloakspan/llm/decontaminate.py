"""Benchmark decontamination: which documents hold a passage of a benchmark.

A document is contaminated by an item if one of its windows, as long in words
as the item, has a similarity of 0.8 or more: the sum of the smaller counts of
the 5-word shingles over the sum of the larger ones (texts of fewer words have
one shingle, all their words).  Words are runs of letters and digits, lower-cased.

1. Windows that cannot reach the similarity are never built.  Positions whose
   shingle may be an item's are found in the row, by a bitmap of fixed size;
   documents with too few are left out.  The others' hits are checked exactly,
   and a window is built where enough hits of its size follow a hit.  Any window
   that reaches the similarity has one that begins at a hit, or ends the
   document, and shares no less.  So nothing is lost here.
2. Equal windows are one from here on, so a passage that a third of all
   documents share is compared once.
3. Windows and items get a SimHash of ``BITS`` bits: a bit is set where more than
   half of the counted shingles' hashes have it.  Counted shingles that are similar
   to s differ in a bit with probability arccos(2s / (1 + s)) / pi, so the bits that
   differ are binomial, and the radius is the least that a pair at the very limit
   exceeds with a probability of at most ``MISS``.
4. Fingerprints within the radius are found by blocks: of ``radius // (NEAR + 1) + 1``
   blocks or more, two such fingerprints differ by at most ``NEAR`` bits in one at least.
   Items are filed under all values near their blocks, windows are looked up by
   theirs, in an equi-join on (size, block, value).  This loses no pair of the radius.
5. What lies within the radius is verified by the exact similarity.

Only SQL functions are used.  Texts are read once and not shuffled.

Defined cases: null and empty texts, in documents or items, match nothing; a
document given twice is reported once for an item, documents without an id under a
null id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import chain, combinations
from math import acos, comb, pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspan.functions.bitmap import Bitmap
from cloakspan.functions.expr import (
    Sql,
    compute_once,
    keep,
    let,
    running,
    struct,
    transform,
)
from cloakspan.functions.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, in words of 64; the chance to miss a pair at the limit;
#: and in how many bits a filed value may differ.
BITS, MISS, NEAR = 128, 1e-6, 2


def radius_of(similarity: float, bits: int = BITS, miss: float = MISS) -> int:
    """The least radius that a pair at the similarity exceeds with a
    probability of at most ``miss``."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    beyond = 1.0
    for r in range(bits):
        beyond -= comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if beyond <= miss:
            return r
    return bits


def blocks_of(radius: int, bits: int = BITS, near: int = NEAR) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of the blocks, which cut every word alike."""
    words = bits // 64
    each = max(-(-(radius // (near + 1) + 1) // words), 2)
    borders = [64 * i // each for i in range(each + 1)]
    return [(w, lo, hi - lo) for w in range(words) for lo, hi in zip(borders, borders[1:])]


def _near_masks(width: int, near: int = NEAR) -> list[int]:
    """What to combine a block's value with to get all values near it."""
    flips = chain.from_iterable(combinations(range(width), n) for n in range(near + 1))
    return [sum(1 << bit for bit in bits) for bits in flips]


def _fingerprint(counted: Sql) -> Sql:
    """The SimHash of a set of hashes, as an array of words."""

    def word(number: int) -> Sql:
        def bit(hashes: Sql, at: Sql) -> Sql:
            ones = f"aggregate({hashes}, 0, (n, x) -> n + cast(shiftright(x, {at}) & 1L AS int))"
            return f"if(2 * {ones} > size({hashes}), shiftleft(1L, {at}), 0L)"

        return let(
            transform(counted, lambda x: f"xxhash64({x}, {number})"),
            lambda hashes: f"aggregate({transform('sequence(0, 63)', lambda at: bit(hashes, at))}, 0L, (w, b) -> w | b)",
        )

    return f"array({', '.join(word(i) for i in range(BITS // 64))})"


def _block_values(blocks: list[tuple[int, int, int]], near: bool) -> Sql:
    """Structs (block, value) of a fingerprint ``fp``, with all near values or
    the own one only."""
    each = []
    for number, (word, low, width) in enumerate(blocks):
        value = f"(shiftrightunsigned(get(fp, {word}), {low}) & {(1 << width) - 1}L)"
        masks = ", ".join(f"{m}L" for m in (_near_masks(width) if near else [0]))
        values = let(value, lambda v, m=masks: transform(f"array({m})", lambda x: f"{v} ^ {x}"))
        each.append(transform(values, lambda v, n=number: struct(block=str(n), value=v)))
    return f"concat({', '.join(each)})"


def _words(text: Sql) -> Sql:
    """The hashes of a text's words."""
    words = keep(
        f"split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+')", lambda w: f"{w} != ''"
    )
    return transform(words, lambda w: f"xxhash64({w})")


def _shingle(words: Sql, at: Sql, width: int) -> Sql:
    parts = ", ".join(f"get({words}, {at} + {i})" for i in range(width))
    return f"xxhash64({width}, {parts})"


def _shingles(words: Sql, begin: Sql, many: Sql, width: Sql) -> Sql:
    """``many`` shingles from the word ``begin`` on; ``width`` from 1 to 5."""
    arms = " ".join(
        f"WHEN {w} THEN "
        + transform(
            f"sequence(cast({begin} AS int), cast({begin} + {many} - 1 AS int))",
            lambda i, w=w: _shingle(words, i, w),
        )
        for w in range(SHINGLE, 0, -1)
    )
    return f"CASE {width} {arms} END"


def _counted(shingles: Sql) -> Sql:
    """A set that stands for the counted shingles: the second, third ... equal
    one becomes a value of its own."""

    def tagged(s: Sql) -> Sql:
        begins = transform(
            s, lambda x, i: f"if({i} = 0 OR get({s}, {i} - 1) != {x}, {i}, 0)", arity=2
        )
        begun = running(begins, lambda a, b: f"greatest({a}, {b})", "0")
        repeated = let(
            begun,
            lambda at: transform(s, lambda x, i: f"xxhash64({x}, {i} - get({at}, {i}))", arity=2),
        )
        once = transform(s, lambda x: f"xxhash64({x}, 0)")
        return f"if(size(array_distinct({s})) = size({s}), {once}, {repeated})"

    return let(f"array_sort({shingles})", tagged)


def _need(size: Sql, many: Sql, similarity: float) -> Sql:
    """The least that ``size`` and ``many`` shingles share at the similarity."""
    return f"cast(ceil(({size} + {many}) * {similarity / (1 + similarity)!r}D - 1e-9) AS int)"


def prepared_items(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Items with words: ``item_id, n, width, many, shingles, counted``."""
    worded = compute_once(items.select(F.col(key).alias("item_id"), text), words=_words(f"`{text}`"))
    sized = worded.where("size(words) > 0").selectExpr(
        "item_id", "words", "size(words) AS n", f"least(size(words), {SHINGLE}) AS width"
    )
    shingled = compute_once(
        sized.selectExpr("*", "n - width + 1 AS many"),
        shingles=_shingles("words", "0", "many", "width"),
    )
    return stage(
        shingled.select(
            "item_id", "n", "width", "many", "shingles",
            F.expr(_counted("shingles")).alias("counted"),
        ),
        "items",
    )


def _suspects(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Documents that may hold an item: ``doc_id, mark, words, hits``."""
    bitmap = Bitmap(items.select(F.explode("shingles").alias("h")))
    least, widths = items.agg(
        F.min(F.ceil(F.col("many") * similarity - 1e-9)), F.collect_set("width")
    ).first()

    def hits(width: int) -> Sql:
        found = transform(
            f"if(size(words) >= {width}, sequence(0, size(words) - {width}), cast(array() AS array<int>))",
            lambda i: let(
                _shingle("words", i, width),
                lambda h: f"if({bitmap.may_hold(h)}, {struct(p=i, h=h)}, NULL)",
            ),
        )
        return f"array_compact({found})"

    worded = compute_once(
        docs.withColumn("mark", F.xxhash64("text")), words=_words("text")
    ).drop("text")
    parts = [hits(w) for w in sorted(widths)]
    found = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    return compute_once(worded, hits=found).where(F.size("hits") >= int(least))


def _windows(suspects: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Windows that may reach the similarity: ``doc_id, mark, n, begin, counted``."""
    sizes = items.select(
        "n", "width", "many", F.explode("shingles").alias("h")
    ).distinct()
    hits = suspects.select("doc_id", "mark", F.size("words").alias("total"), F.explode("hits").alias("hit"))
    hits = hits.select("doc_id", "mark", "total", F.col("hit.p").alias("p"), F.col("hit.h").alias("h"))
    placed = (
        hits.join(sizes, "h")
        .groupBy("doc_id", "mark", "total", "n", "width", "many")
        .agg(F.array_sort(F.collect_set("p")).alias("at"))
    )
    # a document shorter than the item is one window; it shares `need` at least
    placed = placed.selectExpr(
        "*",
        "least(n, total) AS span",
        "least(many, total - width + 1) AS held",
        f"{_need('least(many, total - width + 1)', 'many', similarity)} AS need",
    )
    from_hits = (
        "transform(filter(sequence(0, size(at) - need), j -> get(at, j) <= total - span "
        "AND get(at, j + need - 1) < get(at, j) + held), j -> get(at, j))"
    )
    last = "if(size(filter(at, p -> p >= total - span)) >= need, array(total - span), cast(array() AS array<int>))"
    begins = f"if(size(at) >= need, array_union({from_hits}, {last}), cast(array() AS array<int>))"
    starts = placed.select(
        "doc_id", "mark", "n", "width", "held", "need", F.explode(F.expr(begins)).alias("begin")
    )
    texts = suspects.select("doc_id", "mark", "words").dropDuplicates(["doc_id", "mark"])
    same = texts.select(F.col("doc_id").alias("id"), F.col("mark").alias("id_mark"), "words")
    joined = starts.join(same, F.expr("doc_id <=> id AND mark = id_mark"))
    shingled = compute_once(joined, shingles=_shingles("words", "begin", "held", "width"))
    return shingled.select(
        "doc_id", "mark", "n", "begin",
        F.expr(_counted("shingles")).alias("counted"),
    )


def near_pairs(windows: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(``n, content, item_id``) of windows and items of one size whose
    fingerprints lie within the radius of the similarity."""
    radius = radius_of(similarity)
    blocks = blocks_of(radius)
    filed = compute_once(items.select("n", "item_id", "counted"), fp=_fingerprint("counted")).select(
        "n", "item_id", F.col("fp").alias("item_fp"), F.expr(f"inline({_block_values(blocks, True)})")
    )
    asked = compute_once(windows.select("n", "content", "counted"), fp=_fingerprint("counted")).select(
        "n", "content", "fp", F.expr(f"inline({_block_values(blocks, False)})")
    )
    apart = " + ".join(f"bit_count(get(fp, {w}) ^ get(item_fp, {w}))" for w in range(BITS // 64))
    return (
        asked.join(filed, ["n", "block", "value"])
        .where(f"{apart} <= {radius}")
        .select("n", "content", "item_id")
        .distinct()
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row for each document and item it holds: ``doc_id``, ``item_id``,
    ``similarity`` and the place of the best window (its first word from 0,
    and its words)."""
    items = prepared_items(items, item_key, item_text)
    if items.isEmpty():
        return docs.selectExpr(
            f"`{key}` AS doc_id", "cast(NULL AS bigint) AS item_id", "0D AS similarity",
            "0 AS first_word", "0 AS n_words",
        ).where("false")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    suspects = stage(_suspects(docs, items, similarity), "suspects")
    windows = stage(
        _windows(suspects, items, similarity).withColumn("content", F.xxhash64("counted")),
        "windows",
    )
    distinct = stage(
        windows.groupBy("n", "content").agg(F.first("counted").alias("counted")),
        "distinct-windows",
    )

    candidates = near_pairs(distinct, items, similarity)
    shared = "cast(size(array_intersect(counted, item_counted)) AS double)"
    verified = (
        candidates.join(distinct.select("n", "content", "counted"), ["n", "content"])
        .join(items.select("item_id", "n", F.col("counted").alias("item_counted")), ["item_id", "n"])
        .withColumn("shared", F.expr(shared))
        .withColumn("similarity", F.expr("shared / (size(counted) + size(item_counted) - shared)"))
        .where(F.col("similarity") >= similarity)
        .select("n", "content", "item_id", "similarity")
    )
    return (
        windows.select("doc_id", "n", "begin", "content")
        .join(verified, ["n", "content"])
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("begin")).alias("b"), "n")).alias("best"))
        .select(
            "doc_id", "item_id", "best.similarity",
            (-F.col("best.b")).alias("first_word"), F.col("best.n").alias("n_words"),
        )
    )
