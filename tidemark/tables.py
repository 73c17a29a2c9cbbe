"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_paths: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors.

    The table stays until it is dropped, cleared, or the driver ends. The shuffle files of the write go as soon as it
    is done; Spark would keep them until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _paths:
        atexit.register(_at_exit, spark)
    _paths.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read again; other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path in _paths:
            _paths.remove(path)
            _delete(t.sparkSession, path)


def size(spark: SparkSession) -> tuple[int, int]:
    """Number of written tables that are left, and their bytes."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _paths]
    return len(paths), sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in paths)


def clear(spark: SparkSession) -> int:
    """Delete all tables that this process has written so far; results that still read them must be saved before."""
    n = 0
    while _paths:
        n += _delete(spark, _paths.pop())
    return n


def _at_exit(spark: SparkSession) -> None:
    """What is left goes with the driver, if its session still runs."""
    try:
        clear(spark)
    except Exception:  # the session has ended: there is nobody left to tell
        _paths.clear()
