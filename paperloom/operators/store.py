"""The store as snapshots: every mutation maps old tables to new ones, written whole to a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Whole rows of new replace those of old with the same key; of rows of new with one key the last by `ordinal`, if any."""
    if "ordinal" in new.columns:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ordinal")))).filter("_n = 1").drop("_n", "ordinal")
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key old lacks are added, each key once."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new that insert_ignore would add."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, parent: str, parent_key: str, children: dict[str, str]) -> dict[str, DataFrame]:
    """Remove parents whose key is in gone (its only column), and all their children (table -> foreign key)."""
    ids = gone.toDF("gone_id").distinct()
    out = dict(tables)
    for table, column in {parent: parent_key, **children}.items():
        out[table] = tables[table].join(ids, F.col(column) == F.col("gone_id"), "left_anti")
    return out


def keep_newest(rows: DataFrame, at: str, tie: str, most: int = 500) -> DataFrame:
    """The newest rows. A bounded top-k: each task keeps its own best before the last merge."""
    return rows.orderBy(F.desc(at), F.asc(tie)).limit(most)


def keep_newest_per(rows: DataFrame, by: str, at: str, tie: str, most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.asc(tie)))).filter(F.col("_n") <= most).drop("_n")


def expire(rows: DataFrame, at: str, now: Column, days: int = 7, reading: bool = False) -> DataFrame:
    """Rows of a cache that are younger than the limit. A row of exactly that age is refused on reading but not yet deleted."""
    limit = now - F.make_interval(days=F.lit(days))
    return rows.filter(F.col(at) > limit if reading else F.col(at) >= limit)


def prune_names(names: DataFrame, column: str, pattern: str, keep: int = 3) -> DataFrame:
    """Of the names that match, all but the first `keep` in descending order: those to delete."""
    kept = names.filter(F.col(column).rlike(pattern)).orderBy(F.desc(column)).limit(keep).select(F.col(column).alias("kept"))
    return names.filter(F.col(column).rlike(pattern)).join(kept, F.col(column) == F.col("kept"), "left_anti")


def restore(live: dict[str, DataFrame], backup: dict[str, DataFrame], mode: str = "full", settings: tuple[str, ...] = ("settings",)) -> dict[str, DataFrame]:
    """full: all of backup; library: its tables but the settings; settings: those alone."""
    take = {"full": set(backup), "library": set(backup) - set(settings), "settings": set(settings)}[mode]
    return {name: backup[name] if name in take and name in backup else table for name, table in {**backup, **live}.items()}


def clear_missing_files(docs: DataFrame, files: DataFrame, hash_column: str = "contentHash", id_column: str = "id") -> DataFrame:
    """contentHash becomes null where no file of the document is listed (files: one column, document ids)."""
    there = files.toDF("file_id").distinct().withColumn("_there", F.lit(True))
    return docs.join(there, F.col(id_column) == F.col("file_id"), "left").withColumn(hash_column, F.when(F.col("_there"), F.col(hash_column))).drop("file_id", "_there")


def orphans(children: DataFrame, foreign_key: str, parents: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent; a null foreign key is no orphan."""
    return children.filter(F.col(foreign_key).isNotNull()).join(parents.select(F.col(key).alias("_k")), F.col(foreign_key) == F.col("_k"), "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row a key whose row was added, removed or changed: key, change."""
    columns = [c for c in new.columns if c != key]
    a = old.select(F.col(key).alias("_a"), F.struct(*columns).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*columns).alias("_new"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).filter("change IS NOT NULL")
