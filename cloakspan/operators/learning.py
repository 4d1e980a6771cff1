"""Feedback as tables: learned values, safe values, custom patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..rules import (
    CUSTOM_CONFIDENCE,
    LAYER_CUSTOM,
    LEARNED_ROWS_VERSION,
    LEARNED_VERSION,
    PII_TYPES,
    Rule,
)
from ..schemas import LEARNED_FILE

_EXPORT = (
    "version int, kind string, pii_type string, value string, name string, "
    "confidence double, created_at timestamp"
)


def learn_pii(
    pii: DataFrame, safe: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add ``new(pii_type, value)`` and take the lower values off the safe list."""
    learned = pii.select("pii_type", "value").union(new.select("pii_type", "value"))
    spoken = new.select(F.lower("value").alias("value_lc")).distinct()
    return learned.distinct(), safe.join(spoken, "value_lc", "left_anti")


def learn_safe(
    pii: DataFrame, safe: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add ``new(value)`` to the safe list and drop the value, and its lower
    form, from every type."""
    listed = safe.select("value_lc").union(new.select(F.lower("value")))
    kept = pii.join(_removals(new), "value", "left_anti")
    return kept.select("pii_type", "value"), listed.distinct()


def _removals(values: DataFrame) -> DataFrame:
    return values.select(
        F.explode(F.array("value", F.lower("value"))).alias("value")
    ).distinct()


def apply_feedback(
    pii: DataFrame, safe: DataFrame, decisions: DataFrame, order: str = "decided_at"
) -> tuple[DataFrame, DataFrame]:
    """Replay a batch of decisions on both tables as a set operation.

    A value ends up learned if its last ``yes`` comes after the last ``no`` that
    removes it, and safe if the last ``no`` comes after the last ``yes``.
    ``skip`` changes nothing.  Each side is aggregated before it is joined.
    """
    kind = F.coalesce("type_override", "pii_type")
    yes = decisions.where(F.col("decision") == "yes").select(
        kind.alias("pii_type"), "value", F.col(order).alias("at")
    )
    no = decisions.where(F.col("decision") == "no").select(
        "value", F.col(order).alias("at")
    )
    never = F.lit(None).cast(dict(decisions.dtypes)[order])

    learned = (
        pii.select("pii_type", "value", never.alias("at"))
        .union(yes)
        .groupBy("pii_type", "value")
        .agg(F.max("at").alias("learned_at"))
    )
    removed = (
        no.select(
            F.explode(F.array_distinct(F.array("value", F.lower("value")))).alias(
                "value"
            ),
            "at",
        )
        .groupBy("value")
        .agg(F.max("at").alias("removed_at"))
    )
    new_pii = (
        learned.join(removed, "value", "left")
        .where(F.col("removed_at").isNull() | (F.col("learned_at") > F.col("removed_at")))
        .select("pii_type", "value")
    )

    listed = (
        safe.select("value_lc", never.alias("at"))
        .union(no.select(F.lower("value"), "at"))
        .groupBy("value_lc")
        .agg(F.max("at").alias("listed_at"))
    )
    spoken = (
        yes.select(F.lower("value").alias("value_lc"), "at")
        .groupBy("value_lc")
        .agg(F.max("at").alias("spoken_at"))
    )
    new_safe = (
        listed.join(spoken, "value_lc", "left")
        .where(F.col("spoken_at").isNull() | (F.col("listed_at") > F.col("spoken_at")))
        .select("value_lc")
    )
    return new_pii, new_safe


def type_rank(pii_type: Column) -> Column:
    """Position of a type in the fixed order; unknown types come last."""
    return F.coalesce(
        F.nullif(
            F.array_position(F.array(*[F.lit(t) for t in PII_TYPES]), pii_type),
            F.lit(0).cast("long"),
        ),
        F.lit(len(PII_TYPES) + 1).cast("long"),
    )


def look_up(values: DataFrame, pii: DataFrame, safe: DataFrame) -> DataFrame:
    """Add ``known_type`` (first type that holds the value or its lower form, or
    NULL) and ``known_safe``."""
    first = pii.groupBy("value").agg(
        F.min(F.struct(type_rank(F.col("pii_type")).alias("rank"), "pii_type")).alias(
            "first"
        )
    )
    exact = first.select("value", F.col("first").alias("_exact"))
    lower = first.select(F.col("value").alias("_value_lc"), F.col("first").alias("_low"))
    listed = safe.select(F.col("value_lc").alias("_value_lc")).distinct()
    return (
        values.withColumn("_value_lc", F.lower("value"))
        .join(exact, "value", "left")
        .join(lower, "_value_lc", "left")
        .join(listed.withColumn("_safe", F.lit(True)), "_value_lc", "left")
        .withColumn("known_type", F.least("_exact", "_low")["pii_type"])
        .withColumn("known_safe", F.coalesce("_safe", F.lit(False)))
        .drop("_value_lc", "_exact", "_low", "_safe")
    )


# -- custom patterns ---------------------------------------------------------------


def upsert_patterns(patterns: DataFrame, new: DataFrame) -> DataFrame:
    """Add patterns by name; the last write of a name wins."""
    columns = ["name", "pattern", "pii_type", "confidence", "created_at"]
    row = F.struct("pattern", "pii_type", "confidence", "created_at")
    return (
        patterns.select(*columns)
        .union(new.select(*columns))
        .groupBy("name")
        .agg(F.max_by(row, F.col("created_at")).alias("row"))
        .select("name", "row.*")
    )


def remove_patterns(patterns: DataFrame, names: DataFrame) -> DataFrame:
    return patterns.join(names.select("name").distinct(), "name", "left_anti")


def pattern_rules(patterns: DataFrame) -> tuple[Rule, ...]:
    """Read a short pattern table into detector rules, each of which is searched
    in every text; :func:`patterns.pattern_spans` joins tables of any size."""
    rows = (
        patterns.select("name", "pattern", "pii_type", "confidence")
        .orderBy("created_at", "name")
        .collect()
    )
    return tuple(
        Rule(
            r["name"],
            r["pii_type"] if r["pii_type"] in PII_TYPES else "custom",
            r["pattern"],
            r["confidence"] if r["confidence"] is not None else CUSTOM_CONFIDENCE,
            LAYER_CUSTOM,
            seq,
            ignore_case=False,
        )
        for seq, r in enumerate(rows)
    )


# -- statistics, files ---------------------------------------------------------------


def learning_stats(
    pii: DataFrame, safe: DataFrame, patterns: DataFrame | None = None
) -> DataFrame:
    """Rows ``(kind, pii_type, total)``: learned values per type and in all,
    safe values, custom patterns."""
    out = pii.rollup("pii_type").agg(F.count("*").alias("total"))
    rows = out.select(F.lit("pii").alias("kind"), "pii_type", "total").union(
        safe.agg(F.count("*").alias("total")).select(
            F.lit("safe").alias("kind"),
            F.lit(None).cast("string").alias("pii_type"),
            "total",
        )
    )
    if patterns is not None:
        rows = rows.union(
            patterns.agg(F.count("*").alias("total")).select(
                F.lit("custom_patterns").alias("kind"),
                F.lit(None).cast("string").alias("pii_type"),
                "total",
            )
        )
    return rows


def export_learned(
    pii: DataFrame, safe: DataFrame, path: str, patterns: DataFrame | None = None
):
    """Write the learned tables as JSON rows ``{version, kind, pii_type, value,
    name, confidence, created_at}``; the rows go out in parallel."""

    def rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        return df.select(
            F.lit(LEARNED_ROWS_VERSION).alias("version"),
            F.lit(kind).alias("kind"),
            *[
                columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in StructType.fromDDL(_EXPORT).fields[2:]
            ],
        )

    out = rows(pii, "pii", pii_type=F.col("pii_type"), value=F.col("value")).union(
        rows(safe, "safe", value=F.col("value_lc"))
    )
    if patterns is not None:
        out = out.union(
            rows(
                patterns, "custom_pattern", pii_type=F.col("pii_type"), value=F.col("pattern"),
                name=F.col("name"), confidence=F.col("confidence"), created_at=F.col("created_at"),
            )
        )
    out.write.json(path)


def learned_object(
    pii: DataFrame, safe: DataFrame, patterns: DataFrame | None = None
) -> DataFrame:
    """One row ``value``: the version-1 object, as :func:`read_learned_object`
    reads it.  The form is one document, so it suits stores that one machine can hold."""
    values = pii.groupBy("pii_type").agg(F.array_sort(F.collect_set("value")).alias("v"))
    parts = {
        "pii": values.agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "v")))).alias("pii")
        ),
        "safe": safe.agg(F.array_sort(F.collect_set("value_lc")).alias("safe")),
    }
    if patterns is not None:
        row = F.struct("pattern", "pii_type", F.col("created_at").cast("string").alias("created_at"))
        parts["custom_patterns"] = patterns.agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", row.alias("row"))))).alias(
                "custom_patterns"
            )
        )
    whole = None
    for part in parts.values():  # one row each
        part = part.withColumn("version", F.lit(LEARNED_VERSION))
        whole = part if whole is None else whole.join(part, "version")
    return whole.select(F.to_json(F.struct("version", *parts)).alias("value"))


def read_learned_object(
    spark: SparkSession, path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read version-1 objects ``{version, pii, safe, custom_patterns, metadata}``,
    one per file, into ``(pii, safe, patterns)`` tables."""
    data = spark.read.schema(LEARNED_FILE).json(path, multiLine=True)
    pii = data.select(F.explode("pii").alias("pii_type", "values")).select(
        "pii_type", F.explode("values").alias("value")
    )
    safe = data.select(F.explode("safe").alias("value_lc"))
    patterns = data.select(F.explode("custom_patterns").alias("name", "row")).select(
        "name",
        "row.pattern",
        "row.pii_type",
        F.lit(CUSTOM_CONFIDENCE).alias("confidence"),
        F.col("row.created_at").cast("timestamp").alias("created_at"),
    )
    return pii, safe, patterns


def read_learned(
    spark: SparkSession, path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read what :func:`export_learned` wrote as rows."""
    rows = spark.read.schema(_EXPORT).json(path)
    pii = rows.where(F.col("kind") == "pii").select("pii_type", "value")
    safe = rows.where(F.col("kind") == "safe").select(F.col("value").alias("value_lc"))
    patterns = rows.where(F.col("kind") == "custom_pattern").select(
        "name",
        F.col("value").alias("pattern"),
        "pii_type",
        F.coalesce("confidence", F.lit(CUSTOM_CONFIDENCE)).alias("confidence"),
        "created_at",
    )
    return pii, safe, patterns


def import_learned(
    pii: DataFrame,
    safe: DataFrame,
    new_pii: DataFrame,
    new_safe: DataFrame,
    merge: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Merge imported tables into the present ones, or replace them.

    Unlike learning, importing does not move values between the two tables.
    """
    if not merge:
        return new_pii.distinct(), new_safe.distinct()
    return (
        pii.select("pii_type", "value").union(new_pii.select("pii_type", "value")).distinct(),
        safe.select("value_lc").union(new_safe.select("value_lc")).distinct(),
    )


def import_patterns(patterns: DataFrame, new: DataFrame, merge: bool = True) -> DataFrame:
    """Imported custom patterns, which take the place of present ones of their
    name; without ``merge`` of all."""
    new = upsert_patterns(new.limit(0), new)
    if not merge:
        return new
    return remove_patterns(patterns, new).select(*new.columns).union(new)


def clear_learned(pii: DataFrame, safe: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pii.limit(0), safe.limit(0)


def clear_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.limit(0)
