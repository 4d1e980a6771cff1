"""From raw documents to token ids, in five stages.

Each stage takes the documents that the one before it kept.  ``run`` writes
them as Parquet after every stage, in the shared folder, and reads them back.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspan.functions.staging import delete, scratch, shared_folder
from cloakspan.llm import byte_bpe, decontaminate, quality, secrets, simhash_dedup

#: Its stages train, hash and tokenise as SQL cannot; tests compare it with
#: brute force on a small corpus.
ORACLE_SQL = None

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those of
    the given documents that are labelled and not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, which tells rows apart by id and text, so rows that
    share an id, or have none, are decided one by one.  Rows with an id come first."""
    row = F.struct(F.isnull("doc_id").alias("last"), "doc_id", F.xxhash64("text").alias("text"))
    return docs.withColumn("_row", row)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id; of rows with one id, or none,
    the one whose text hashes lowest.  Rows that repeat an id and a text stay together.
    Groups are op9's links of 3 bits and no looser, so near copies with more changes
    stay; the README has shares."""
    rows = _with_row(docs)
    groups = simhash_dedup.near_duplicates(rows, "_row")
    first = groups.where("_row = component_id").select("_row").distinct()
    return rows.join(first, "_row", "left_semi").drop("_row")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark, with or without an id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _with_row(docs)
    found = decontaminate.contaminated(rows, benchmark, "_row").select(F.col("doc_id").alias("_row"))
    return rows.join(found.distinct(), "_row", "left_anti").drop("_row")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        n_chars = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", n_chars)
    return clean


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts, and their number."""
    path = public_tokenizers.path(TOKENIZER)
    ids = byte_bpe.encode_texts(docs, path, public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("byte-level bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's tables are deleted when the next one is written,
    as the first three hold texts with their secrets."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES:
        with scratch(spark):
            out = apply(spark, docs, sf_dir)
            path = f"{shared_folder(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
            out.write.parquet(path)
        if written:
            delete(spark, written)
        docs, written = spark.read.schema(out.schema).parquet(path), path
    return docs
