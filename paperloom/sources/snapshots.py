"""Versioned tables: each publication writes a new version, then moves a pointer, so readers see all of it or none.

The pointer is a one-row table in a folder of its own name; the newest complete pointer counts. A crash before the pointer is
written leaves the last version current, and a later publication never reuses a number.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("version bigint, tables array<string>").json(f"{root}/_current")
    except AnalysisException:
        return None


def current(spark: SparkSession, root: str) -> tuple[int, list[str]] | None:
    """The number and tables of the published version."""
    pointers = _pointers(spark, root)
    row = pointers.filter("version IS NOT NULL").orderBy(F.desc("version")).first() if pointers is not None else None
    return (row["version"], row["tables"]) if row else None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write all tables as the next version and make it current; tables not given are carried on from the version before."""
    now = current(spark, root)
    version = (now[0] if now else 0) + 1
    carried = {t: read(spark, root, t) for t in (now[1] if now else []) if t not in tables}
    for name, df in {**carried, **tables}.items():
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
    names = sorted({**carried, **tables})
    spark.createDataFrame([(version, names)], "version bigint, tables array<string>").coalesce(1).write.mode("append").json(f"{root}/_current")
    return version


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the published version."""
    now = current(spark, root)
    if now is None or table not in now[1]:
        raise FileNotFoundError(f"{table} is not published under {root}")
    return spark.read.parquet(f"{root}/v={now[0]}/{table}")


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, bytes and SHA-256 of files."""
    return files.select(path, F.octet_length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose entry differs between two manifests: a backup made between them is refused if there are any."""
    return before.exceptAll(after).union(after.exceptAll(before)).select("path").distinct()
