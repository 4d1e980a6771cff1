"""Audit of how filters interact: what each one removes in every order.

A filter fails a document or not, whatever ran before it, so a document is one
bit mask, and equal masks are one cell with counts.  A recursive CTE starts from
the cells' masks with nothing applied and extends each prefix by every unused
letter; it joins the mask cells at each level, carries the applied bits along, and
emits the metrics of the level's step.  A prefix is thus evaluated once for all orders
that begin with it.  The recursion's rows depend on the number of filters only
(326 prefixes of five letters, 32 masks); counts of parts join its result.

Documents enter cells as (part, mask, labels) counts, summed before the shuffle.
The first of equal texts is found on digests, of which a hot one leaves a task as
one row for each part, mask and label.

Defined cases: null texts are empty, null parts the empty string; a document without
an id neither repeats one nor is repeated; rows that share an id and a text repeat
nothing; of several labels of an id any 1 counts; labels without an id are ignored; an
empty table has no parts and so no rows; other columns are ignored.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakspan.functions.staging import stage

#: Filters an audit may have: the recursion of six stays under the 1,000,000
#: rows that Spark lets a recursive CTE return, seven would not.
MOST_FILTERS = 6

#: The failure conditions of the text filters A to D, over `text` and its `words`.
TEXT_FILTERS = {
    "A": "size(words) < 200",
    "B": "100 * size(array_distinct(words)) < 50 * size(words)",
    "C": "100 * length(regexp_replace(text, '[^A-Z]', '')) > 3 * length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
#: Fails what repeats the text of a smaller id.
REPEATS = "E"
LETTERS = "ABCDE"


def _bit(letter: str, letters: str = LETTERS) -> int:
    return 1 << letters.index(letter)


def text_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id``, ``part``, the text's ``digest`` and the ``mask`` of A to D."""
    plain = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    bits = " + ".join(
        f"if({fails}, {_bit(letter)}, 0)" for letter, fails in TEXT_FILTERS.items()
    )
    return (
        plain.withColumn("words", words)
        .withColumn("digest", F.unhex(F.sha2("text", 256)))
        .select("doc_id", "part", "digest", F.expr(bits).alias("mask"))
    )


def cells(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """Documents by ``part`` and ``mask``: their number ``n``, and how many
    are labelled ``good`` and ``toxic``."""
    once = ["doc_id", "part", "digest", "mask"]
    rows = text_masks(docs, key, text, part).groupBy(*once).agg(F.count("*").alias("n"))
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(
            F.max(F.expr("if(quality = 1, 1, 0)")).alias("good"),
            F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic"),
        )
        .withColumnRenamed("doc_id", "labelled")
    )
    marked = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left").fillna(
        0, ["good", "toxic"]
    )
    same = ["digest", "part", "mask", "good", "toxic"]
    grouped = marked.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.sum(F.expr("if(doc_id IS NULL, n, 0)")).alias("without_id"),
        # per id one row is left here, so this carries all rows of the least id
        F.min(F.expr("if(doc_id IS NULL, NULL, struct(doc_id, n))")).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    kept = F.expr("without_id + if(least.doc_id = first, least.n, 0)")
    split = (
        grouped.withColumn("first", first)
        .withColumn("kept", F.coalesce(kept, "without_id"))
        .withColumn(
            "both",
            F.array(
                F.struct(F.col("mask").alias("mask"), F.col("kept").alias("n")),
                F.struct(
                    (F.col("mask") + F.lit(_bit(REPEATS))).alias("mask"),
                    (F.col("n") - F.col("kept")).alias("n"),
                ),
            ),
        )
        .select("part", "good", "toxic", F.explode("both").alias("cell"))
    )
    return (
        split.where("cell.n > 0")
        .groupBy("part", "cell.mask")
        .agg(
            F.sum("cell.n").alias("n"),
            F.sum(F.col("cell.n") * F.col("good")).alias("good"),
            F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"),
        )
    )


def steps(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For each mask and each sequence of different letters: what its last
    step does to the mask's documents (0 or 1 in each metric)."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: their orders are enumerated")
    listed = ", ".join(
        f"named_struct('letter', '{letter}', 'bit', {_bit(letter, letters)})" for letter in letters
    )
    return masks.sparkSession.sql(
        f"""
        WITH RECURSIVE steps AS (
          SELECT mask, '' AS prefix, 0 AS applied, 0 AS step, '' AS letter,
                 1 AS kept, 0 AS removed, 0 AS redundant, 0 AS unique_fails
          FROM {{masks}}
          UNION ALL
          SELECT c.mask, concat(s.prefix, f.letter), s.applied | f.bit, s.step + 1, f.letter,
                 if(c.mask & (s.applied | f.bit) = 0, 1, 0),
                 if(c.mask & s.applied = 0 AND c.mask & f.bit <> 0, 1, 0),
                 if(c.mask & s.applied <> 0 AND c.mask & f.bit <> 0, 1, 0),
                 if(c.mask = f.bit, 1, 0)
          FROM steps s JOIN {{masks}} c ON c.mask = s.mask
          LATERAL VIEW explode(filter(array({listed}), x -> s.applied & x.bit = 0)) t AS f
        )
        SELECT * FROM steps WHERE step > 0
        """,
        masks=masks,
    )


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For each part of ``counted`` (``part, mask, n, good, toxic``), each
    order of all letters and each of its steps, the documents in every metric."""
    counted = stage(counted, "mask-cells")
    many = len(letters)
    metrics = stage(
        counted.join(steps(counted.select("mask").distinct(), letters), "mask")
        .groupBy("part", "prefix", "letter", "step")
        .agg(
            *(F.sum(F.col("n") * F.col(m)).alias(m) for m in ("kept", "removed", "redundant", "unique_fails")),
            F.sum(F.col("good") * F.col("removed")).alias("good_lost"),
            F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"),
        ),
        "audit-steps",
    )
    # so many full orders begin with a prefix
    orders = F.element_at(
        F.array(*(F.lit(factorial(many - k)) for k in range(1, many + 1))), F.col("step")
    )
    shapley = metrics.groupBy("part", "letter").agg(
        F.sum(F.col("removed") * orders).alias("shapley")
    )
    full = metrics.where(F.col("step") == many).select(
        "part",
        F.col("prefix").alias("filter_order"),
        F.explode(F.sequence(F.lit(1), F.lit(many))).alias("at"),
    )
    full = full.withColumn("prefix", F.expr("substring(filter_order, 1, at)")).drop("at")
    return (
        full.join(metrics, ["part", "prefix"])
        .join(shapley, ["part", "letter"])
        .select(
            "part", "filter_order", "step",
            *(F.col(c).cast("long").alias(c) for c in (
                "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
            )),
        )
    )


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole ``documents`` texts, by ``lang``."""
    return audit(cells(docs, labels))
