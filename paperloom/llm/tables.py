"""Reading the input tables; intermediate tables are those of paperloom.sources.scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.scratch import forget, new_path, stored

__all__ = ["forget", "new_path", "read", "stored"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
