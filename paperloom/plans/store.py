"""Queries over the snapshot operators, with tables split by parity into a live and a backup side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import linkage, merge, metrics, store
from paperloom.plans.registry import query, table


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal + 1 AS balance FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return store.upsert(old, old.filter("id % 3 = 0").withColumn("balance", F.col("balance") + 1), ["id"])


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    tables = {"customer": customers, "orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")}
    return store.delete_cascade(tables, customers.filter("c_nationkey = 7").select("c_custkey"), "customer", "c_custkey", {"orders": "o_custkey"})["orders"]


@query("""SELECT favourite, count(*)::BIGINT AS n_docs, string_agg(doc::VARCHAR, ',' ORDER BY doc) AS docs FROM
  (SELECT DISTINCT c_nationkey AS favourite, c_custkey AS doc FROM customer) GROUP BY favourite""")
def favorites_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("favourite"), F.col("c_custkey").alias("doc")).distinct()
    return members.groupBy("favourite").agg(F.count("*").alias("n_docs"), F.array_join(F.array_sort(F.collect_list("doc")), ",").alias("docs"))


_PAIRS = "SELECT o_custkey % 10 AS favourite, o_orderkey % 1000 AS doc FROM orders WHERE o_orderkey % {0}"


@query(f"{_PAIRS.format('2 = 0')} UNION {_PAIRS.format('3 = 0')}")
def favorites_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("favourite"), (F.col("o_orderkey") % 1000).alias("doc"))
    live, backup = (pairs.filter(f"o_orderkey % {n} = 0").drop("o_orderkey") for n in (2, 3))
    return live.union(backup).distinct()


@query(f"SELECT favourite, count(*)::BIGINT AS added FROM ({_PAIRS.format('3 = 0')} EXCEPT {_PAIRS.format('2 = 0')}) GROUP BY favourite")
def favorites_new_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("favourite"), (F.col("o_orderkey") % 1000).alias("doc"))
    live, backup = (pairs.filter(f"o_orderkey % {n} = 0").drop("o_orderkey") for n in (2, 3))
    return store.missing(live, backup, ["favourite", "doc"]).groupBy("favourite").agg(F.count("*").alias("added"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS journal,
  CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'y' || c_nationkey END AS year FROM customer""")
def enrich_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    live = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("  ")).alias("journal"),
                    F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("y"), F.col("c_nationkey"))).alias("year"))
    backup = c.select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("journal"), F.col("c_mktsegment").alias("year"))
    return linkage.enrich(live, backup, "id", ("journal", "year"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN (CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE 'mine' END)
  ELSE (CASE WHEN c_custkey % 3 = 1 THEN 'new ' || c_name WHEN c_custkey % 3 = 0 THEN c_name ELSE 'mine' END) END AS title FROM customer""")
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    n = F.col("id") % 3
    current = c.select("id", F.when(n == 0, F.col("name")).when(n == 1, F.lit(None)).otherwise(F.lit("mine")).alias("title"))
    current = current.withColumn("title", F.when((F.col("id") % 4 == 0) & (n == 1), F.lit("mine")).otherwise(F.col("title")))
    incoming = c.select("id", F.concat(F.lit("new "), "name").alias("title"))
    return linkage.merge_from_source(current, incoming, c.filter("id % 4 = 0").select("id", F.col("name").alias("title")), "id", ("title",))


@query("""WITH b AS (SELECT event_id AS id, CASE WHEN user_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS docId FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0 AND user_id % 5 <> 0)
SELECT event_id AS id, user_id AS docId FROM events WHERE event_id % 2 = 0 UNION ALL SELECT id, docId FROM b""")
def highlight_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("docId"))
    id_map = e.filter("docId % 5 <> 0").select(F.col("docId").alias("old")).distinct().withColumn("new", F.expr("CASE WHEN old % 4 = 0 THEN old + 1 ELSE old END"))
    return merge.highlights(e.filter("id % 2 = 0"), e.filter("id % 3 = 0"), id_map)


@query("""SELECT c_mktsegment || c_nationkey AS "settingKey", min(c_custkey) AS value FROM customer WHERE c_nationkey < 20 GROUP BY 1
UNION ALL SELECT c_mktsegment || c_nationkey, max(c_custkey) FROM customer WHERE c_nationkey >= 20 AND c_nationkey <> 24 GROUP BY 1""")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("settingKey", F.concat("c_mktsegment", F.col("c_nationkey")))
    live = c.filter("c_nationkey < 20").groupBy("settingKey").agg(F.min("c_custkey").alias("value"))
    backup = c.filter("c_nationkey <> 24").groupBy("settingKey").agg(F.max("c_custkey").alias("value"))
    return merge.settings(live, backup)


@query("""WITH b AS (SELECT o_orderkey AS k, o_custkey AS d FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 <> 0 AND o_custkey % 3 <> 0)
SELECT o_orderkey AS "zoteroKey", o_custkey AS "docId" FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT k, d + 100000 FROM b""")
def sync_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("zoteroKey"), F.col("o_custkey").alias("docId"))
    id_map = o.select(F.col("docId").alias("old")).filter("old % 3 <> 0").distinct().withColumn("new", F.col("old") + 100000)
    return merge.synced_items(o.filter("zoteroKey % 2 = 0"), o.filter("zoteroKey % 5 = 0"), id_map)


_PRINTS = "SELECT l_orderkey AS id, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber) AS content, max(l_returnflag) AS meta, sum(l_suppkey)::BIGINT AS files FROM lineitem GROUP BY 1"


@query(f"""WITH p AS ({_PRINTS})
SELECT id, CASE WHEN id % 11 = 0 THEN 'added' WHEN id % 3 = 0 THEN 'content' WHEN id % 4 = 0 THEN 'meta' WHEN id % 5 = 0 THEN 'files' ELSE 'synced' END AS status FROM p""")
def change_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    prints = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("content"), F.max("l_returnflag").alias("meta"), F.sum("l_suppkey").alias("files"))
    old = prints.filter("id % 11 <> 0").select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("other")).otherwise(F.col("content")).alias("content"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("meta")).alias("meta"), F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(F.col("files")).alias("files"))
    return linkage.change_status(prints, old)


@query("""SELECT CASE WHEN GROUPING(source) = 1 THEN 'total' ELSE source END AS grp, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ROLLUP (source)""")
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.storage_report(table(spark, sf_dir, "documents"), F.col("source"), F.col("n_chars"))


@query("""SELECT source, sha256(string_agg(line, chr(10) ORDER BY line)) AS print FROM
  (SELECT source, 'doc' || doc_id || chr(9) || n_chars AS line FROM documents) GROUP BY source""")
def collection_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("doc"), F.col("doc_id"), F.lit("\t"), F.col("n_chars")).alias("line"))
    return metrics.fingerprint(rows, "source", "line", "print")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def retention_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_newest_per(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey")


@query("""WITH q AS (SELECT p_partkey, p_size, p_size % 2 AS supp FROM part)
SELECT p_partkey, supp FROM q ORDER BY supp, p_size DESC, p_partkey LIMIT 200""")
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") % 2).alias("supp"))
    return metrics.quota(parts, "supp", [F.desc("p_size"), F.asc("p_partkey")], 200).select("p_partkey", "supp")


@query("""SELECT c_custkey AS id, CASE WHEN o IS NULL THEN NULL ELSE 'h' || c_custkey END AS "contentHash" FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c_custkey = o""")
def clear_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("h"), F.col("c_custkey")).alias("contentHash"))
    return store.clear_missing_files(docs, table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return store.orphans(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey").select("o_orderkey")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'removed' WHEN p_partkey % 4 = 1 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_partkey % 4 <> 3""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = p.filter("id % 4 <> 0").withColumn("name", F.when(F.col("id") % 4 == 2, F.lit("x")).otherwise(F.col("name")))
    return store.diff(p.filter("id % 4 <> 1"), new, "id")


@query("""SELECT c_custkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576.0, 1))
  ELSE printf('%.2f GB', round(n / 1073741824.0, 2)) END AS size FROM (SELECT c_custkey, c_custkey::BIGINT * c_custkey::BIGINT AS n FROM customer)""")
def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("bigint")
    return table(spark, sf_dir, "customer").select("c_custkey", T.format_size(n * n).alias("size"))
