"""Arriving session texts, redacted batch by batch.

Every micro-batch is one run of the batch plan.  What it adds to the mapping
goes to a folder for the hour in which its session opened and the batch's id,
written with overwrite: a batch that is repeated after a failure reads the same
earlier folders and puts the same rows in the same place.

A session ends an hour after its first text.  One that comes back later is
opened anew, and counts anew: the opening time is part of the scope's key.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.placeholders import taken_numbers
from ..functions.staging import scratch, stage
from ..operators.crypto import Keyring
from ..operators.detect import Detector
from ..operators.mapping import (
    assign_placeholders,
    distinct_values,
    last_numbers,
    seal,
)
from ..operators.redact import (
    NO_LAYERS,
    SAFE,
    SKIP_UNCERTAIN,
    Layers,
    Policy,
    decide,
    splice_units,
    unit_spans,
)
from ..rules import SESSION_HOURS
from ..schemas import STREAM_MAPPING

KEYED = ["scope_id", "pii_type", "value_key"]
HOUR = "yyyy-MM-dd-HH"


def read_mapping(spark: SparkSession, path: str, hours: list[str] | None = None) -> DataFrame:
    """The stored mapping, or the part whose sessions opened in given hours.

    Only those folders are looked at, so the history costs nothing.
    """
    system_path = spark._jvm.org.apache.hadoop.fs.Path
    system = system_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folders = [path] if hours is None else [f"{path}/hour={h}" for h in hours]
    there = [f for f in folders if system.exists(system_path(f))]
    if not there:
        return spark.createDataFrame([], STREAM_MAPPING)
    return spark.read.schema(STREAM_MAPPING).option("basePath", path).parquet(*there)


def live_hours(first: datetime, last: datetime) -> list[str]:
    """The hours in which a session may have opened that is live at some time
    from ``first`` to ``last``."""
    hour = (first - timedelta(hours=SESSION_HOURS)).replace(minute=0, second=0, microsecond=0)
    hours = []
    while hour <= last:
        hours.append(hour.strftime("%Y-%m-%d-%H"))
        hour += timedelta(hours=1)
    return hours


def earlier_mapping(
    spark: SparkSession, path: str, batch_id: int, texts: DataFrame
) -> DataFrame:
    """Mapping rows of earlier batches that belong to sessions of this batch and
    have not expired."""
    # as text: folders are named in the session's time zone, not in Python's
    first, last = texts.agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss"),
    ).first()
    if first is None:
        return spark.createDataFrame([], STREAM_MAPPING)
    hours = live_hours(datetime.fromisoformat(first), datetime.fromisoformat(last))
    stored = read_mapping(spark, path, hours).where(F.col("batch_id") < batch_id)
    begun = texts.groupBy("session_id").agg(F.min("ts").alias("first_ts"))
    return (
        stored.join(begun, "session_id")
        .where(
            F.col("created_at") + F.expr(f"INTERVAL {SESSION_HOURS} HOUR")
            >= F.col("first_ts")
        )
        .drop("first_ts")
    )


def batch_writer(
    mapping_path: str,
    out_path: str,
    keyring: Keyring,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    layers: Layers = NO_LAYERS,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function for ``(session_id, ts, unit_no, text)``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            run(batch, batch_id)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        texts = stage(
            batch.withColumns(
                {
                    "session_id": F.col("session_id").cast("string"),
                    "unit_no": F.col("unit_no").cast("int"),
                }
            ),
            "batch",
        )
        # inside a batch the session is the scope; its key is put in when written
        units = texts.select(
            F.col("session_id").alias("scope_id"),
            F.col("session_id").alias("doc_id"),
            "unit_no", "ts", "text",
        )
        earlier = stage(earlier_mapping(spark, mapping_path, batch_id, texts), "earlier")
        known = earlier.drop("scope_id").withColumnRenamed("session_id", "scope_id")
        since = earlier.groupBy("session_id").agg(F.min("created_at").alias("since"))
        begun = texts.groupBy("session_id").agg(F.min("ts").alias("first_ts"))
        opened = stage(
            begun.join(since, "session_id", "left")
            .withColumn("opened_at", F.coalesce("since", "first_ts"))
            .select(
                "session_id",
                "opened_at",
                F.concat_ws("/", "session_id", F.unix_seconds("opened_at")).alias("key"),
            ),
            "opened",
        )

        spans = stage(
            decide(unit_spans(units, detector, policy, mode, layers=layers), mode, policy),
            "spans",
        )
        taken = None
        if policy.avoid_taken:
            found = F.expr(f"inline({taken_numbers('text')})").alias("pii_type", "n")
            taken = units.select("scope_id", found).distinct()
        values = distinct_values(spans, policy.numbering).withColumn(
            "value_key", keyring.digest(F.col("value_lc"))
        )
        fresh = values.join(known.select(*KEYED), KEYED, "left_anti")
        numbered = assign_placeholders(
            spans, policy.numbering, last_numbers(known), values=fresh,
            document_scopes=True, taken=taken,
        )
        added = stage(
            seal(numbered, keyring)
            .drop("created_at")
            .withColumnRenamed("scope_id", "session_id")
            .join(opened, "session_id"),
            "added",
        )
        (
            added.withColumnsRenamed({"key": "scope_id", "opened_at": "created_at"})
            .withColumn("hour", F.date_format("created_at", HOUR))
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("hour", "batch_id")
            .parquet(mapping_path)
        )
        columns = [*KEYED, "n", "placeholder"]
        fresh_rows = added.withColumnRenamed("session_id", "scope_id")
        mapping = known.select(*columns).unionByName(fresh_rows.select(*columns))
        keyed = spans.withColumn("value_key", keyring.digest(F.lower("text")))
        edits = keyed.join(mapping, KEYED)
        done = splice_units(units, edits, policy).select(
            F.col("scope_id").alias("session_id"), "unit_no", "ts", "redacted"
        )
        (
            done.join(opened.select("session_id", F.col("key").alias("scope_id")), "session_id")
            .write.mode("overwrite")
            .parquet(f"{out_path}/batch_id={batch_id}")
        )

    return write


def redact_stream(
    texts: DataFrame,
    mapping_path: str,
    out_path: str,
    checkpoint: str,
    keyring: Keyring,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    layers: Layers = NO_LAYERS,
    **trigger,
):
    """Start the stream over ``(session_id, ts, unit_no, text)``."""
    writer = texts.writeStream.foreachBatch(
        batch_writer(mapping_path, out_path, keyring, detector, policy, mode, layers)
    ).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
