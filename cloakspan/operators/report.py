"""Reports: scans, per-document results, leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_counts(spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Spans per document, status and type, with the document's subtotals and
    the grand total as the rows whose finer columns are NULL."""
    return spans.rollup(doc_id, "status", "pii_type").agg(F.count("*").alias("spans"))


def scan_summary(spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: all, high-confidence and uncertain detections."""
    return spans.groupBy(doc_id).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "match").alias("high"),
        F.count_if(F.col("status") == "uncertain").alias("uncertain"),
    )


def unit_stats(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """Per unit with any span: replaced and uncertain spans."""
    unit = ["scope_id", "doc_id", "unit_no"]
    uncertain = spans.groupBy(*unit).agg(
        F.count_if(F.col("status") == "uncertain").alias("uncertain")
    )
    replaced = edits.groupBy(*unit).agg(F.count("*").alias("redacted"))
    return uncertain.join(replaced, unit, "full").select(
        *unit,
        F.coalesce("redacted", F.lit(0)).cast("long").alias("redacted"),
        F.coalesce("uncertain", F.lit(0)).cast("long").alias("uncertain"),
    )


def type_counts(edits: DataFrame, keys: list[str]) -> DataFrame:
    return edits.groupBy(*keys, "pii_type").agg(F.count("*").alias("redacted"))


def document_report(
    units: DataFrame, spans: DataFrame, edits: DataFrame, doc_id: str = "doc_id"
) -> DataFrame:
    """One row per document, also for those without a hit.

    The counts are summed before they meet, so the joins see one row per
    document (and type), never spans.
    """
    sizes = units.groupBy(doc_id).agg(F.count("*").alias("n_units"))
    uncertain = spans.groupBy(doc_id).agg(
        F.count_if(F.col("status") == "uncertain").alias("uncertain")
    )
    by_type = (
        type_counts(edits, [doc_id])
        .groupBy(doc_id)
        .agg(
            F.sum("redacted").alias("total"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("pii_type", "redacted")))
            ).alias("by_type"),
        )
    )
    return (
        sizes.join(by_type, doc_id, "left")
        .join(uncertain, doc_id, "left")
        .select(
            doc_id,
            F.coalesce("total", F.lit(0)).cast("long").alias("total"),
            F.coalesce(
                "by_type", F.create_map().cast("map<string,bigint>")
            ).alias("by_type"),
            F.coalesce("uncertain", F.lit(0)).cast("long").alias("uncertain"),
            "n_units",
        )
    )


def leftovers(
    raw: DataFrame, edits: DataFrame
) -> DataFrame:
    """Raw spans that stay partly visible: not inside one replaced span.

    Both sides meet per unit, and a unit's arrays are bounded by its text.
    """
    unit = ["scope_id", "doc_id", "unit_no"]
    kept = edits.groupBy(*unit).agg(
        F.collect_list(F.struct("start", "end")).alias("kept")
    )
    covered = F.exists(
        F.coalesce("kept", F.array().cast("array<struct<start:int,end:int>>")),
        lambda k: (k["start"] <= F.col("start")) & (k["end"] >= F.col("end")),
    )
    return raw.join(kept, unit, "left").where(~covered).drop("kept")
