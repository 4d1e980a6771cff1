"""Text files of any size as detection units, and their spans.

A file is read line by line over many tasks, and its lines are put together to
units that no hit crosses.  A hit can cross a line end only where the characters
on both sides of the white space fit together (a *seam*); everywhere else the file
may be cut.  So the spans of the units, moved by where a unit starts, are those of
the whole file, and no task holds more than a unit and the block it was read from.

Line ends of any kind become ``\\n``; one at the very end of a file is not kept.
A file without lines has no unit.  A line, or a run of lines of which each fits
the next at a seam, stays in one unit and has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.staging import stage
from ..operators.detect import Detector, detect_spans

#: What stands left and right of the white space in a hit of a built-in rule or
#: of a name; the second one adds phrases after a keyword (``Detector.contextual``).
SEAM = r"^(?U)(?:[\d)][\d(]|[\p{L}']\p{Lu})$"
CONTEXTUAL_SEAM = r"^(?U)(?:[\d)][\d(]|[\p{L}':]\p{L})$"

#: Code points of a unit, unless a run of seams is longer.
UNIT_CHARS = 1 << 16

_SOLID = r"(?Us)^[\s\x1c-\x1f]*+(.)"


def seam_of(detector: Detector) -> str:
    """The seam of a detector.  What custom patterns and learned values cross is
    not known: such detectors need a seam given by hand."""
    if detector.custom_patterns or detector.learned_pii:
        raise ValueError("give a seam for custom patterns and learned values")
    return CONTEXTUAL_SEAM if detector.contextual else SEAM


def _fits(left: Column, right: Column, seam: str) -> Column:
    return F.concat(left, right).rlike(seam)


def _solid(text: Column) -> Column:
    """The first character that is no white space; null where there is none."""
    return F.nullif(F.regexp_extract(text, _SOLID, 1), F.lit(""))


def _lines(spark: SparkSession, paths: tuple[str, ...], folders: bool) -> DataFrame:
    """Lines with the block of the file they were read from; ``line`` ascends
    inside a block.  With ``folders`` a folder's files, by name, are one file."""
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return spark.read.text(list(paths)).select(
        (F.regexp_replace(path, "/[^/]*$", "") if folders else path).alias("doc_id"),
        F.struct(path.alias("file"), start.alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("text"),
    )


def _pieces(lines: DataFrame, seam: str, unit_chars: int) -> DataFrame:
    """Lines of a block put together.  Piece -1 holds the lines before the first
    cut of the block, which may belong to the block before it."""
    block = Window.partitionBy("doc_id", "block").orderBy("line")
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lines.withColumns(
        {"first": _solid(F.col("text")), "last": _solid(F.reverse("text")), "size": F.length("text") + 1}
    )
    placed = seen.withColumns(
        {
            "at": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "cut": ~_fits(F.last("last", True).over(before), F.col("first"), seam),
        }
    )
    begun = F.last(F.when(F.col("cut"), F.col("at")), True).over(so_far)
    piece = F.coalesce(F.floor(begun / unit_chars).cast("int"), F.lit(-1))
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return (
        placed.withColumn("piece", piece)
        .groupBy("doc_id", "block", "piece")
        .agg(
            F.min("at").alias("at"),
            F.sum("size").alias("size"),
            F.expr("min_by(first, line) FILTER (WHERE first IS NOT NULL)").alias("first"),
            F.expr("max_by(last, line) FILTER (WHERE last IS NOT NULL)").alias("last"),
            F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"),
        )
    )


def _blocks(pieces: DataFrame, seam: str) -> DataFrame:
    """A row for each block: where it starts, its first unit number, and, where
    its lines before the first cut belong to an earlier unit, that unit."""
    file = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = pieces.groupBy("doc_id", "block").agg(
        F.sum("size").alias("size"),
        F.max("piece").alias("piece"),
        F.expr("min_by(first, piece) FILTER (WHERE first IS NOT NULL)").alias("first"),
        F.expr("max_by(last, piece) FILTER (WHERE last IS NOT NULL)").alias("last"),
    )
    # blank lines belong to what stands before them
    before = F.last("last", True).over(file)
    joined = before.isNotNull() & F.coalesce(_fits(before, F.col("first"), seam), F.lit(True))
    own = F.when((F.col("piece") >= 0) | ~F.col("joined"), F.struct("block", "piece"))
    return found.withColumn("joined", joined).select(
        "doc_id",
        "block",
        F.coalesce(F.sum("size").over(file), F.lit(0)).alias("begin"),
        F.coalesce(F.sum(F.col("piece") + 2).over(file), F.lit(0)).alias("number"),
        F.when(F.col("joined"), F.last(own, True).over(file)).alias("target"),
    )


def read_file_units(
    spark: SparkSession,
    *paths: str,
    seam: str = SEAM,
    unit_chars: int = UNIT_CHARS,
    folders: bool = False,
) -> DataFrame:
    """``scope_id, doc_id, part, unit_no, start, text``: text files cut into units.

    The file is document and scope; ``unit_no`` ascends with the place in the
    file, with gaps; ``start`` is that place in code points.  Between two units
    of a file there is one ``\\n``.  ``seam`` is a pattern for the two characters
    around white space that a hit may cross.

    With ``folders`` the document is a folder, as :func:`write_file_units` writes it:
    its part files, in the order of their names, are the file.
    """
    pieces = stage(_pieces(_lines(spark, paths, folders), seam, unit_chars), "pieces")
    # a row for each block, so the planner sees how small it is
    blocks = stage(_blocks(pieces, seam), "blocks")
    placed = pieces.join(blocks, ["doc_id", "block"])
    moves = (F.col("piece") == -1) & F.col("target").isNotNull()
    more = stage(
        placed.where(moves)
        .groupBy("doc_id", "target")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]
                ),
                "\n",
            ).alias("more")
        )
        .select("doc_id", "target.block", "target.piece", "more"),
        "moved",
    )
    return (
        placed.where(~moves)
        .join(more, ["doc_id", "block", "piece"], "left")
        .select(
            F.col("doc_id").alias("scope_id"),
            "doc_id",
            F.lit("text").alias("part"),
            (F.col("number") + F.col("piece") + 1).cast("int").alias("unit_no"),
            (F.col("begin") + F.col("at")).alias("start"),
            # null where no lines have moved here
            F.concat_ws("\n", "text", "more").alias("text"),
        )
    )


def file_spans(units: DataFrame, detector: Detector | None = None) -> DataFrame:
    """The claimed spans of whole files: ``doc_id``, the fields of a span, with
    ``start`` and ``end`` as places in the file (bigint)."""
    found = units.select(
        "doc_id",
        F.col("start").alias("begin"),
        F.explode(F.expr(detect_spans("text", detector or Detector()))).alias("span"),
    )
    moved = found.select("doc_id", "begin", "span.*")
    return moved.withColumns(
        {"start": F.col("begin") + F.col("start"), "end": F.col("begin") + F.col("end")}
    ).drop("begin")


def write_file_units(units: DataFrame, path: str, text: str = "text") -> None:
    """Units as text files, a folder ``file=...`` for each document.  The part
    files of a folder, in the order of their names, are the file, with a line
    end at its end."""
    name = F.regexp_replace("doc_id", r"[/:]", "_")
    (
        units.select(name.alias("file"), "unit_no", F.col(text).alias("value"))
        .repartitionByRange("file", "unit_no")
        .sortWithinPartitions("file", "unit_no")
        .select("file", "value")
        .write.option("lineSep", "\n")
        .partitionBy("file")
        .text(path)
    )
