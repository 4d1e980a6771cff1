"""Tables as documents: every string cell is a detection unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.expr import is_blank, keep
from ..functions.placeholders import taken_numbers
from ..functions.spans import splice
from ..functions.staging import stage
from ..operators.detect import Detector
from ..operators.mapping import assign_placeholders
from ..operators.redact import (
    NO_LAYERS,
    SAFE,
    SKIP_UNCERTAIN,
    Layers,
    Policy,
    decide,
    edits_of,
    unit_spans,
)
from ..operators.restore import restore_units


def check_unique(df: DataFrame, row_id: str) -> None:
    """Fail clearly where edits could not be told apart."""
    again = df.groupBy(row_id).count().where("count > 1").first()
    if again is not None:
        raise ValueError(f"{row_id} is not unique: {again[0]!r} occurs {again[1]} times")


def string_columns(df: DataFrame, row_id: str) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, StringType) and f.name != row_id
    ]


def cell_units(df: DataFrame, row_id: str, scope: Column | None = None) -> DataFrame:
    """String cells as units: ``doc_id`` is the row, ``unit_no`` the column.

    NULL cells, blank cells and other types are left out.  The default scope
    is the table.
    """
    names = string_columns(df, row_id)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("unit_no"),
                F.lit(name).alias("part"),
                F.col(name).alias("text"),
            )
            for i, name in enumerate(names)
        ]
    )
    rows = df.select(
        (scope if scope is not None else F.lit("table")).alias("scope_id"),
        F.col(row_id).alias("doc_id"),
        F.inline(cells),
    )
    return rows.where(f"text IS NOT NULL AND NOT ({is_blank('text')})").select(
        "scope_id", "doc_id", "part", "unit_no", "text"
    )


def _put_back(df: DataFrame, row_id: str, edits: DataFrame) -> DataFrame:
    """Splice edits ``(doc_id, unit_no, start, end, placeholder)`` into the cells;
    column order and other columns stay.  Each row is joined once."""
    names = string_columns(df, row_id)
    per_row = edits.groupBy(F.col("doc_id").alias(row_id)).agg(
        F.array_sort(
            F.collect_list(F.struct("start", "end", "placeholder", "unit_no"))
        ).alias("_edits")
    )

    def cell(i: int, name: str) -> Column:
        mine = keep("_edits", lambda e: f"{e}.unit_no = {i}")
        spliced = splice(f"`{name}`", mine)
        return F.expr(f"if(_edits IS NULL, `{name}`, {spliced})")

    changed = {name: cell(i, name) for i, name in enumerate(names)}
    return (
        df.join(per_row, row_id, "left")
        .select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])
    )


def redact_table(
    df: DataFrame,
    row_id: str,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    layers: Layers = NO_LAYERS,
) -> tuple[DataFrame, DataFrame]:
    """Redact all string columns of a table whose ``row_id`` is unique.

    Returns the table with schema and column order kept, and the mapping.  The
    placeholders count through the whole table, in row then column order; a row
    id that occurs twice is an error.
    """
    check_unique(df, row_id)
    cells = cell_units(df, row_id)
    spans = stage(unit_spans(cells, detector, policy, mode, layers=layers), "cells")
    accepted = decide(spans, mode, policy)
    taken = None
    if policy.avoid_taken:
        found = cells.select("scope_id", F.expr(f"inline({taken_numbers('text')})").alias("pii_type", "n"))
        taken = stage(found.distinct(), "taken")
    mapping = stage(assign_placeholders(accepted, policy.numbering, taken=taken), "mapping")
    edits = edits_of(accepted, mapping)
    return _put_back(df, row_id, edits), mapping


def restore_table(
    df: DataFrame, row_id: str, mapping: DataFrame, **options
) -> tuple[DataFrame, DataFrame]:
    """Restore all string cells; also returns the restorations per row."""
    check_unique(df, row_id)
    names = string_columns(df, row_id)
    cells = restore_units(cell_units(df, row_id), mapping, **options).where(
        F.col("restorations") > 0
    )
    per_row = cells.groupBy(F.col("doc_id").alias(row_id)).agg(
        F.map_from_entries(
            F.collect_list(F.struct("unit_no", "restored"))
        ).alias("_cells"),
        F.sum("restorations").alias("restorations"),
    )
    joined = df.join(per_row, row_id, "left")
    columns = [
        F.coalesce(F.try_element_at("_cells", F.lit(names.index(c))), F.col(c)).alias(c)
        if c in names
        else F.col(c)
        for c in df.columns
    ]
    return joined.select(*columns), per_row.select(row_id, "restorations")
