"""Reading history: latest opening of each document, recency sections, merges and usage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, doc: str, at: str, *carried: str) -> DataFrame:
    """One row a document: its last opening, with other columns of that row."""
    last = F.max(F.struct(F.col(at).alias("at"), *(F.col(c).alias(c) for c in carried))).alias("last")
    return events.groupBy(F.col(doc).alias("doc")).agg(last).select("doc", F.col("last.at").alias("opened_at"), *(F.col(f"last.{c}").alias(c) for c in carried))


def section(opened_at: Column, today: Column) -> Column:
    """today (and later), yesterday, thisWeek (after today - 7 days), thisMonth, or the month as yyyy-MM; the first that fits."""
    day = F.to_date(opened_at)
    return (F.when(day >= today, "today").when(day == F.date_sub(today, 1), "yesterday").when(day > F.date_sub(today, 7), "thisWeek")
            .when(day >= F.trunc(today, "month"), "thisMonth").otherwise(F.date_format(day, "yyyy-MM")))


def sections(history: DataFrame, docs: DataFrame, doc_key: str, today: Column) -> DataFrame:
    """Sections of history rows (doc, opened_at) whose document exists: how many documents, newest and oldest opening."""
    known = docs.select(F.col(doc_key).alias("doc"))
    rows = history.join(known, "doc", "left_semi").withColumn("section", section(F.col("opened_at"), today))
    return rows.groupBy("section").agg(F.count("*").alias("n_docs"), F.max("opened_at").alias("newest"), F.min("opened_at").alias("oldest"), F.sum("doc").alias("doc_sum"))


def merge(live: DataFrame, backup: DataFrame, id_map: DataFrame, most: int = 500) -> DataFrame:
    """History rows (doc, opened_at, progress) of both sides, backup ids mapped (id_map: old, new) and unmapped ones dropped.

    The later opening wins, then the larger progress, then the live row. Of several backup rows that map to one document the
    best wins; the newest `most` rows stay.
    """
    mapped = backup.join(id_map, F.col("doc") == F.col("old"), "inner").select(F.col("new").alias("doc"), "opened_at", "progress")
    both = live.select("doc", "opened_at", "progress", F.lit(1).alias("own")).unionByName(mapped.withColumn("own", F.lit(0)))
    best = both.groupBy("doc").agg(F.max(F.struct("opened_at", "progress", "own")).alias("best"))
    rows = best.select("doc", "best.opened_at", "best.progress", (F.col("best.own") == 1).alias("from_live"))
    return rows.orderBy(F.desc("opened_at"), "doc").limit(most)


def merge_by_live(live: DataFrame, backup: DataFrame, id_map: DataFrame, most: int = 500) -> DataFrame:
    """The variant in which every backup row is compared with the live row alone, and the last that beats it (by ordinal) wins."""
    mapped = backup.join(id_map, F.col("doc") == F.col("old")).select(F.col("new").alias("doc"), "opened_at", "progress", "ordinal")
    mine = live.select("doc", F.col("opened_at").alias("live_at"), F.col("progress").alias("live_progress"))
    joined = mapped.join(mine, "doc", "left")
    wins = F.col("live_at").isNull() | (F.col("opened_at") > F.col("live_at")) | ((F.col("opened_at") == F.col("live_at")) & (F.col("progress") > F.col("live_progress")))
    won = joined.filter(wins).groupBy("doc").agg(F.max_by(F.struct("opened_at", "progress"), "ordinal").alias("w")).select("doc", "w.opened_at", "w.progress")
    rows = won.unionByName(live.select("doc", "opened_at", "progress").join(won.select("doc"), "doc", "left_anti"))
    return rows.orderBy(F.desc("opened_at"), "doc").limit(most)


def daily_usage(events: DataFrame, at: str, by: str, amount: Column) -> DataFrame:
    """Amount by day and provider."""
    return events.groupBy(F.to_date(at).alias("day"), F.col(by).alias("provider")).agg(F.sum(amount).alias("pages"))
