"""End-to-end corpus runs: read, redact, report, write, restore."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import scratch
from ..operators.crypto import Keyring
from ..operators.detect import Detector
from ..operators.mapping import clear_scopes, load_mapping, save_mapping, seal
from ..operators.redact import (
    NO_LAYERS,
    SAFE,
    SKIP_UNCERTAIN,
    Layers,
    Policy,
    redact_rows,
    redact_units,
    row_mapping,
)
from ..operators.report import document_report
from ..operators.restore import restore_units
from ..sources.large_files import UNIT_CHARS, read_file_units, seam_of, write_file_units
from ..sources.units import join_units, split_units, whole_units


def redact_documents(
    docs: DataFrame,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, text, ...)`` that are their own scope.

    Returns ``(redacted documents, plain mapping)``; both are narrow plans.
    """
    redacted = redact_rows(docs, detector, policy, mode)
    mapping = row_mapping(redacted, ["doc_id"]).withColumnRenamed("doc_id", "scope_id")
    return redacted.drop("spans"), mapping


def redact_corpus(
    docs: DataFrame,
    out: str,
    keyring: Keyring,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    separator: str | None = "\n",
    scope: str = "document",
    layers: Layers = NO_LAYERS,
) -> None:
    """Redact documents cut into units and write texts, mapping and report.

    ``scope='corpus'`` gives a value the same placeholder in every document.
    Only ciphertext and digests of the originals are written below ``out``;
    what the run staged, originals included, is deleted at its end.
    """
    with scratch(docs.sparkSession):
        units = cut_units(docs, separator, scope)
        run = redact_units(
            units, detector, policy, mode, document_scopes=scope != "corpus", layers=layers
        )
        redacted = run.texts.select("doc_id", "unit_no", F.col("redacted").alias("text"))
        join_units(redacted, separator or "").write.parquet(f"{out}/texts")
        save_mapping(seal(run.mapping, keyring), f"{out}/mapping", keyring)
        document_report(units, run.spans, run.edits).write.parquet(f"{out}/report")


def redact_files(
    spark: SparkSession,
    paths: Sequence[str],
    out: str,
    keyring: Keyring,
    detector: Detector | None = None,
    policy: Policy = SAFE,
    mode: str = SKIP_UNCERTAIN,
    layers: Layers = NO_LAYERS,
    seam: str | None = None,
    unit_chars: int = UNIT_CHARS,
) -> None:
    """Redact text files of any size, each file its own scope; texts, mapping and
    report as :func:`redact_corpus` writes them, the texts as text files.

    Dictionaries and pattern tables need the ``seam`` their values may cross.
    """
    if seam is None:
        if layers != NO_LAYERS:
            raise ValueError("give a seam for the values of the layers")
        seam = seam_of(detector or Detector())
    with scratch(spark):
        units = read_file_units(spark, *paths, seam=seam, unit_chars=unit_chars)
        run = redact_units(units, detector, policy, mode, layers=layers)
        write_file_units(run.texts, f"{out}/texts", "redacted")
        save_mapping(seal(run.mapping, keyring), f"{out}/mapping", keyring)
        document_report(units, run.spans, run.edits).write.parquet(f"{out}/report")


def cut_units(docs: DataFrame, separator: str | None, scope: str) -> DataFrame:
    """Documents ``(doc_id, text)`` as units of a document or corpus scope."""
    scope_id = F.lit("corpus") if scope == "corpus" else F.col("doc_id").cast("string")
    if separator is None:
        return whole_units(docs, scope=scope_id)
    return split_units(docs, separator, scope=scope_id)


def restore_corpus(
    docs: DataFrame,
    mapping_path: str,
    out: str,
    password: str,
    rounds: int | None = None,
    separator: str | None = "\n",
    scope: str = "document",
) -> DataFrame:
    """Restore documents ``(doc_id, text)`` from a saved mapping: cut as they were
    redacted, restore the units, join them and write the texts to ``out``.

    Returns the stored mapping without the restored scopes, for a caller that
    keeps a mapping no longer than it is needed.
    """
    spark = docs.sparkSession
    mapping, keyring = load_mapping(spark, mapping_path, password, rounds)
    with scratch(spark):
        units = cut_units(docs, separator, scope)
        restored = restore_units(units, mapping, keyring=keyring)
        texts = restored.select("doc_id", "unit_no", F.col("restored").alias("text"))
        join_units(texts, separator or "").write.parquet(out)
    return clear_scopes(mapping, cut_units(docs, separator, scope))
