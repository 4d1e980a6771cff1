"""Documents to detection units and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import NOTES_PREFIX, PAGE_SEPARATOR, SHEET_HEADER, SLIDE_HEADER


def split_units(
    docs: DataFrame,
    separator: str = "\n",
    doc_id: str = "doc_id",
    text: str = "text",
    scope: Column | None = None,
    part: str = "paragraph",
) -> DataFrame:
    """One row per unit between separators (a literal), empty ones included."""
    quoted = "".join(c if c.isalnum() else "\\" + c for c in separator)
    return docs.select(
        (scope if scope is not None else F.col(doc_id)).alias("scope_id"),
        F.col(doc_id).alias("doc_id"),
        F.lit(part).alias("part"),
        F.posexplode(F.split(F.col(text), quoted, -1)).alias("unit_no", "text"),
    )


def whole_units(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    scope: Column | None = None,
) -> DataFrame:
    """Every document as one unit."""
    return docs.select(
        (scope if scope is not None else F.col(doc_id)).alias("scope_id"),
        F.col(doc_id).alias("doc_id"),
        F.lit("text").alias("part"),
        F.lit(0).alias("unit_no"),
        F.col(text).alias("text"),
    )


def join_units(
    units: DataFrame, separator: str = "\n", text: str = "text"
) -> DataFrame:
    """Put the units of every document back together, in unit order.

    A document's units end in one string by definition.
    """
    return units.groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("unit_no", F.col(text).alias("t")))),
                lambda u: u["t"],
            ),
            separator,
        ).alias("text")
    )


def join_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages ``(doc_id, unit_no, text)`` with a page break between them."""
    filled = pages.withColumn(text, F.coalesce(text, F.lit("")))
    return join_units(filled, PAGE_SEPARATOR, text)


def join_sheets(cells: DataFrame) -> DataFrame:
    """Sheets as text: a header per sheet, a line per row with tabs between the
    non-empty cells.

    ``cells``: ``doc_id, sheet_no, sheet, row_no, col_no, value``.  Rows are
    joined first, so only lines meet per document.
    """
    rows = (
        cells.where(F.col("value").isNotNull())
        .groupBy("doc_id", "sheet_no", "row_no")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("col_no", "value"))),
                    lambda c: c["value"],
                ),
                "\t",
            ).alias("line")
        )
    )
    heads = (
        cells.select("doc_id", "sheet_no", "sheet")
        .distinct()
        .select(
            "doc_id", "sheet_no", F.lit(-1).cast("long").alias("row_no"),
            F.format_string(SHEET_HEADER, F.col("sheet")).alias("line"),
        )
    )
    return _join_lines(
        rows.select("doc_id", "sheet_no", F.col("row_no").cast("long"), "line").union(heads)
        .withColumnRenamed("sheet_no", "a")
        .withColumnRenamed("row_no", "b")
    )


def join_slides(shapes: DataFrame) -> DataFrame:
    """Slides as text: a header per slide, a line per shape with text, then the
    notes.

    ``shapes``: ``doc_id, slide_no, shape_no, kind ('shape'|'notes'), text``.
    """
    shown = shapes.where(F.trim("text") != "").select(
        "doc_id",
        F.col("slide_no").alias("a"),
        F.when(F.col("kind") == "notes", F.lit(2**31))
        .otherwise(F.col("shape_no"))
        .cast("long")
        .alias("b"),
        F.when(
            F.col("kind") == "notes", F.concat(F.lit(NOTES_PREFIX), F.col("text"))
        )
        .otherwise(F.col("text"))
        .alias("line"),
    )
    heads = (
        shapes.select("doc_id", "slide_no")
        .distinct()
        .select(
            "doc_id", F.col("slide_no").alias("a"), F.lit(-1).cast("long").alias("b"),
            F.format_string(SLIDE_HEADER, F.col("slide_no").cast("string")).alias("line"),
        )
    )
    return _join_lines(shown.union(heads))


def _join_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("a", "b", "line"))),
                lambda x: x["line"],
            ),
            "\n",
        ).alias("text")
    )
