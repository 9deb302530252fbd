"""Queries over events as a reading history: sections, merges, usage, and the batch twins of the streaming views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import history, store
from paperloom.plans.registry import query, table
from paperloom.streaming import views

TODAY = "2024-01-30"
# Which document an event opens: eight slots a user, one for each kind of event.
_KINDS = ("signup", "error", "click", "view", "other")
_SLOT = "CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"
_DOC_SQL = f"(user_id * 8 + {_SLOT})"


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr(_DOC_SQL).cast("bigint").alias("doc"), "ts", "event_id", "value")


_LATEST = f"SELECT {_DOC_SQL}::BIGINT AS doc, max(ts) AS opened_at FROM events GROUP BY 1"
_SECTION = f"""CASE WHEN opened_at::DATE >= DATE '{TODAY}' THEN 'today' WHEN opened_at::DATE = DATE '{TODAY}' - 1 THEN 'yesterday'
  WHEN opened_at::DATE > DATE '{TODAY}' - 7 THEN 'thisWeek' WHEN opened_at::DATE >= date_trunc('month', DATE '{TODAY}') THEN 'thisMonth'
  ELSE strftime(opened_at, '%Y-%m') END"""


@query(f"""WITH h AS ({_LATEST}) SELECT {_SECTION} AS section, count(*)::BIGINT AS n_docs, max(opened_at) AS newest, min(opened_at) AS oldest,
  sum(doc)::BIGINT AS doc_sum FROM h WHERE doc IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def history_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = history.latest(openings(spark, sf_dir), "doc", "ts")
    return history.sections(opened, table(spark, sf_dir, "customer"), "c_custkey", F.to_date(F.lit(TODAY)))


@query(f"WITH h AS ({_LATEST}) SELECT doc, opened_at FROM h ORDER BY opened_at DESC, doc LIMIT 500")
def history_latest_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_newest(history.latest(openings(spark, sf_dir), "doc", "ts"), "opened_at", "doc", 500)


_SIDES = f"""SELECT {_DOC_SQL}::BIGINT AS doc, event_id, ts AS opened_at, round(value - floor(value), 6) AS progress FROM events"""


@query(f"""WITH e AS ({_SIDES}), live AS (SELECT doc, max((opened_at, progress)) AS m FROM e WHERE event_id % 2 = 0 GROUP BY doc),
bak AS (SELECT doc, max((opened_at, progress)) AS m FROM e WHERE event_id % 2 = 1 GROUP BY doc),
b AS (SELECT CASE WHEN doc % 3 = 0 THEN doc - 1 ELSE doc END AS doc, m FROM bak WHERE doc % 7 <> 0),
u AS (SELECT doc, m, 1 AS own FROM live UNION ALL SELECT doc, m, 0 FROM b),
w AS (SELECT doc, max((m[1], m[2], own)) AS x FROM u GROUP BY doc)
SELECT doc, x[1] AS opened_at, x[2] AS progress, x[3] = 1 AS from_live FROM w ORDER BY opened_at DESC, doc LIMIT 500""")
def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = openings(spark, sf_dir).withColumn("progress", F.round(F.col("value") - F.floor("value"), 6))
    live = history.latest(rows.filter("event_id % 2 = 0"), "doc", "ts", "progress")
    backup = history.latest(rows.filter("event_id % 2 = 1"), "doc", "ts", "progress")
    id_map = backup.filter("doc % 7 <> 0").select(F.col("doc").alias("old"), F.expr("CASE WHEN doc % 3 = 0 THEN doc - 1 ELSE doc END").alias("new"))
    return history.merge(live, backup, id_map)


@query("SELECT ts::DATE AS day, event_type AS provider, sum(user_id)::BIGINT AS pages FROM events GROUP BY 1, 2")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.daily_usage(table(spark, sf_dir, "events"), "ts", "event_type", F.col("user_id"))


@query(f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{TODAY} 00:00:00' - INTERVAL 7 DAY")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.expire(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit(TODAY).cast("timestamp_ntz"))


_GAPS = """WITH g AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id, min(ts) AS started, max((ts, event_id))[2] AS last_event, count(*)::BIGINT AS n_events FROM s GROUP BY user_id, n"""


@query(_GAPS)
def debounce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.debounced(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "1 hour")


@query("""SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS slot, max((ts, event_id))[2] AS last_event, count(*)::BIGINT AS n_events FROM events GROUP BY 1, 2""")
def throttle_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.throttled(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "6 hours")


@query("""WITH p AS (SELECT user_id, event_id, ts, (floor(value)::BIGINT % 4) / 10.0 AS progress FROM events),
l AS (SELECT *, lag(progress) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM p)
SELECT user_id, event_id, progress FROM l WHERE before IS NULL OR abs(progress - before) >= 0.0001""")
def change_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("progress", (F.floor("value") % 4) / F.lit(10.0))
    return views.changes(rows, "user_id", ["ts", "event_id"], "progress", 1e-4).select("user_id", "event_id", "progress")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*)::BIGINT AS n_deltas FROM conversations GROUP BY conv_id")
def stream_fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.folded(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""WITH m AS (SELECT c_custkey AS key, (c_custkey * 37) % 1000 AS version FROM customer)
SELECT key, version FROM m WHERE version > 500""")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), ((F.col("c_custkey") * 37) % 1000).alias("version"))
    return views.since(items, "version", 500)


@query("""SELECT o_custkey AS item, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS succeeded, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS failed,
  count(*) FILTER (o_orderstatus IN ('F', 'P'))::BIGINT AS completed, count(*)::BIGINT AS total FROM orders GROUP BY 1""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item")).agg(
        F.count_if(state == "F").alias("succeeded"), F.count_if(state == "P").alias("failed"), F.count_if(state.isin("F", "P")).alias("completed"), F.count("*").alias("total"))
