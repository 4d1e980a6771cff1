"""Written tables that cut lineage between the passes of a long job."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Open(threading.local):
    """The paths staged inside each open :func:`scratch` of a thread."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_open = _Open()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where every task runs on this machine, may fall back
    to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all nodes share")
    folder = tempfile.mkdtemp(prefix="cloakspan-stage-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so later passes neither repeat the
    work nor depend on executors that may be gone.

    Staged spans hold original values: guard the folder like the source data,
    and run jobs inside :func:`scratch`, which deletes what they staged.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open.blocks:
        _open.blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, every table staged inside the block.

    For jobs that write their outputs before they return; a table that is
    handed on must not be staged inside.
    """
    _open.blocks.append([])
    try:
        yield
    finally:
        for path in _open.blocks.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of this engine, in whichever file system it is."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.delete(jvm_path, True)
