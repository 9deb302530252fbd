"""Merging a backup into a live library: highlights, favourites, settings, synchronised items and files, ids mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remapped(rows: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    """Rows whose id in column has a new one, which replaces it."""
    m = id_map.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return rows.join(m, F.col(column) == F.col("_old")).withColumn(column, F.col("_new")).drop("_old", "_new")


def orphan_count(rows: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    m = id_map.select(F.col("old").alias("_old"))
    return rows.filter(F.col(column).isNotNull()).join(m, F.col(column) == F.col("_old"), "left_anti").agg(F.count("*").alias("orphans"))


def highlights(live: DataFrame, backup: DataFrame, id_map: DataFrame, keep_anchor: bool = False) -> DataFrame:
    """Live highlights and those of the backup with an unknown id and a mapped document. The anchor is left out unless kept."""
    fresh = remapped(backup.join(live.select("id"), "id", "left_anti"), id_map, "docId")
    if not keep_anchor and "anchor" in fresh.columns:
        fresh = fresh.withColumn("anchor", F.lit(None).cast(fresh.schema["anchor"].dataType))
    return live.unionByName(fresh)


def favourite_members(live: DataFrame, backup: DataFrame, id_map: DataFrame) -> DataFrame:
    """Union of the member sets (favoriteId, docId)."""
    return live.unionByName(remapped(backup, id_map, "docId")).distinct()


def settings(live: DataFrame, backup: DataFrame, local_only: tuple[str, ...] = ()) -> DataFrame:
    """Live settings, and those of the backup that are neither live nor local to a machine."""
    fresh = backup.filter(~F.col("settingKey").isin(*local_only)) if local_only else backup
    return live.unionByName(fresh.join(live.select("settingKey"), "settingKey", "left_anti"))


def synced_items(live: DataFrame, backup: DataFrame, id_map: DataFrame) -> DataFrame:
    """Live items, and backup items with an unknown key and a mapped document."""
    return live.unionByName(remapped(backup.filter("docId IS NOT NULL").join(live.select("zoteroKey"), "zoteroKey", "left_anti"), id_map, "docId"))


def library_version(live: DataFrame, backup: DataFrame) -> DataFrame:
    """The larger of two versions; one that isn't a number counts as 0."""
    number = F.coalesce(F.expr("try_cast(value AS BIGINT)"), F.lit(0))
    return live.select(number.alias("v")).unionByName(backup.select(number.alias("v"))).agg(F.max("v").alias("version"))


def missing_files(live: DataFrame, backup: DataFrame, id_map: DataFrame) -> DataFrame:
    """Backup files (docId, path) to copy: those whose mapped document lacks the path."""
    return remapped(backup, id_map, "docId").join(live.select("docId", "path"), ["docId", "path"], "left_anti").dropDuplicates(["docId", "path"])
