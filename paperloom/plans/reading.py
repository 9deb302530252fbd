"""Queries over anchors, quotes, paired occurrences and cached translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import metrics, reader
from paperloom.plans.registry import query, table

_PARAS = "SELECT conv_id AS doc, turn AS paragraph, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE text IS NOT NULL"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("doc"), F.col("turn").alias("paragraph"), flat.alias("text"))


@query(rf"""WITH p AS ({_PARAS}), h AS (SELECT doc || ':' || paragraph AS id, doc, trim(substr(text, 6, 12)) AS q FROM p WHERE length(trim(substr(text, 6, 12))) > 0),
j AS (SELECT h.id, p.paragraph, strpos(p.text, h.q) - 1 AS start, length(h.q) AS n, strpos(substr(p.text, strpos(p.text, h.q) + 1), h.q) AS again FROM h JOIN p ON h.doc = p.doc AND contains(p.text, h.q))
SELECT id, any_value(paragraph) AS paragraph, any_value(start)::INT AS start, any_value(start + n)::INT AS end FROM j WHERE again = 0 GROUP BY id HAVING count(*) = 1""")
def anchor_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    none = F.lit(None).cast("string")
    marks = p.select(F.concat_ws(":", "doc", "paragraph").alias("id"), "doc", F.substring("text", 6, 12).alias("quote"), none.alias("prefix"), none.alias("suffix"))
    return reader.restored(marks, p)


@query(rf"""WITH p AS ({_PARAS}), k AS (SELECT doc, paragraph, regexp_replace(text, '[\s\x{{00AD}}\x{{200B}}\x{{00A0}}]+', '', 'g') AS k, regexp_replace(substr(text, 4, 25), '[\s\x{{00AD}}\x{{200B}}\x{{00A0}}]+', '', 'g') AS q FROM p)
SELECT a.doc || ':' || a.paragraph AS id, any_value(b.paragraph) AS paragraph FROM k a JOIN k b ON a.doc = b.doc AND contains(b.k, a.q) WHERE a.q <> '' GROUP BY 1 HAVING count(*) = 1""")
def quote_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    return reader.paragraph_of_quote(p.select(F.concat_ws(":", "doc", "paragraph").alias("id"), "doc", F.substring("text", 4, 25).alias("quote")), p)


_SIDE = "SELECT o_custkey AS k, o_orderkey AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders WHERE {0}"


@query(f"SELECT a.k, a.place, b.place AS other FROM ({_SIDE.format('o_orderkey % 2 = 0')}) a JOIN ({_SIDE.format('o_orderkey % 2 = 1')}) b ON a.k = b.k AND a.n = b.n AND a.c = b.c")
def occurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("place"))
    a, b = (metrics.occurrences(rows.filter(f"place % 2 = {half}"), ["k"], ["place"]) for half in (0, 1))
    return reader.paired(a, b, ["k"]).select("k", "place", "other")


@query("""SELECT doc_id, doc_id % 3 <> 0 AS pending, CASE WHEN doc_id % 3 = 0 THEN 'tr ' || doc_id END AS translated FROM documents""")
def translation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("h"), F.col("doc_id")).alias("hash"), "text")
    cache = p.select("doc_id", "hash", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" tr "), F.col("doc_id"))).otherwise(F.lit(" ")).alias("translation")).filter("doc_id % 2 = 0 OR doc_id % 3 = 0")
    return reader.with_translations(p, cache.drop("doc_id")).select("doc_id", "pending", "translated")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size % 3 = 0 THEN p_size + 100 END AS value FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0""")
def first_known_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("int")
    wanted = parts.select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("a"), size), F.concat(F.lit("b"), size), F.concat(F.lit("c"), size)).alias("keys"))
    known = parts.select(size.alias("s")).distinct()
    known = known.filter("s % 2 = 0").select(F.concat(F.lit("a"), F.col("s")).alias("key"), F.col("s").alias("value")).union(known.filter("s % 3 = 0").select(F.concat(F.lit("b"), F.col("s")), F.col("s") + 100))
    return reader.first_known(wanted, "keys", known)


@query()
def fuzzy_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    needle = F.concat(F.substring("text", 10, 8), F.lit("x"), F.substring("text", 19, 8))
    return p.select("doc", "paragraph", reader.fuzzy_place(F.col("text"), needle).alias("at"))
