"""Intermediate tables in the folder that executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a temporary folder if driver and tasks are one process on one
    machine; else an error, because executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="paperloom-"))
        folder = _local[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back, so later jobs neither recompute nor depend on executors
    that may be lost. Tables stay until `forget` or `clear`."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of `stored` that nothing reads any more, such as the last round of an iteration."""
    path = getattr(df, "scratch_path", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> int:
    """Delete every intermediate table that this process has written, once its results have been consumed. Returns how many."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n
