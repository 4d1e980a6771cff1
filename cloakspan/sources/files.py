"""Text files in, redacted and restored files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import EXTENSION_FAMILY


def extension_of(path: Column) -> Column:
    """Lower-case extension with its dot; leading dots of a name are no
    extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    core = F.regexp_replace(name, r"^\.+", "")
    return F.lower(F.regexp_extract(core, r"(\.[^.]*)$", 1))


def supported_extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(EXTENSION_FAMILY.items()), "extension string, family string"
    )


def family_of(extension: Column) -> Column:
    """The family that reads an extension, or NULL where none does."""
    chain = F.lit(None).cast("string")
    for name, family in EXTENSION_FAMILY.items():
        chain = F.when(extension == name, F.lit(family)).otherwise(chain)
    return chain


def route_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``extension``, ``family`` and, where unsupported, ``error``."""
    extension = extension_of(F.col(path))
    routed = files.withColumn("extension", extension).withColumn(
        "family", family_of(F.col("extension"))
    )
    return routed.withColumn(
        "error",
        F.when(
            F.col("family").isNull(),
            F.concat(F.lit("unsupported file type: "), F.col("extension")),
        ),
    )


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Paths and sizes below a folder; the contents are not read."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", "modificationTime")


def read_text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole files as ``(doc_id, text)`` with line ends as ``\\n``."""
    lines = spark.read.text(list(paths), wholetext=True)
    return lines.select(
        F.col("_metadata.file_path").alias("doc_id"),
        F.regexp_replace("value", r"\r\n?", "\n").alias("text"),
    )


def _split_name(path: Column) -> tuple[Column, Column]:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    core = F.regexp_replace(name, r"^\.+", "")
    suffix = F.regexp_extract(core, r"(\.[^.]*)$", 1)
    base = F.substr(path, F.lit(1), F.length(path) - F.length(suffix))
    return base, suffix


def redacted_name(path: Column) -> Column:
    """``a/b.txt`` -> ``a/b_redacted.txt``."""
    base, suffix = _split_name(path)
    return F.concat(base, F.lit("_redacted"), suffix)


def restored_name(path: Column) -> Column:
    """``a/b_redacted.txt`` -> ``a/b_restored.txt``."""
    base, suffix = _split_name(path)
    plain = F.regexp_replace(base, r"_redacted\z", "")
    return F.concat(plain, F.lit("_restored"), suffix)


def write_texts(
    df: DataFrame, path: str, text: str, name: Column, fmt: str = "parquet"
):
    """Write texts with their output name.

    ``text`` format writes one folder per name; the table formats keep the
    number of files independent of the number of documents.
    """
    named = df.select(name.alias("output_name"), F.col(text).alias("text"))
    if fmt == "text":
        folder = F.regexp_replace("output_name", r"[/:]", "_")
        named.select(folder.alias("output_name"), "text").write.option(
            "lineSep", "\n"
        ).partitionBy("output_name").text(path)
    else:
        named.write.format(fmt).save(path)
