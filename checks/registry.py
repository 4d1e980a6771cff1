"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def span_columns(df: DataFrame, *extra: str, key: str = "doc_id") -> DataFrame:
    """Spans with plain column types and names both engines accept."""
    return df.select(
        key,
        F.col("start").cast("long").alias("span_start"),
        F.col("end").cast("long").alias("span_end"),
        "text",
        "pii_type",
        *extra,
    )


SPAN_SQL = (
    "doc_id, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end, "
    "t AS text, typ AS pii_type"
)
