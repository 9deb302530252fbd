"""Queries over figures and captions: order lines as blocks of pages, where one order is a page and a hundred customers' orders a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import figures
from paperloom.plans.registry import query, table

#: Blocks of 300 by 90 in two columns; every third supplier's is an image, and every fifth part's text is a caption.
_BLOCKS = """SELECT l_orderkey % 1000 AS doc, l_orderkey // 1000 AS page, l_linenumber AS block, (min(l_partkey) % 2) * 400.0 + 50 AS l, l_linenumber * 100.0 + (min(l_suppkey) % 4) * 25 AS t,
  CASE WHEN min(l_suppkey) % 3 = 0 THEN 'image' WHEN min(l_partkey) % 5 = 0 THEN 'figure_title' WHEN min(l_partkey) % 5 = 1 THEN 'vision_footnote' ELSE 'text' END AS label,
  CASE WHEN min(l_partkey) % 5 = 0 THEN 'Figure ' || l_linenumber || '. Of it' ELSE repeat('word ', (min(l_partkey) % 40)::INT) END AS content FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Pages are dealt out once; all steps on a page stay there.
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("doc"), F.expr("l_orderkey div 1000").alias("page"), F.col("l_linenumber").alias("block"), "l_partkey", "l_suppkey")
    lines = rows.repartition("doc", "page").groupBy("doc", "page", "block").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    titled = F.col("p") % 5 == 0
    label = F.when(F.col("s") % 3 == 0, "image").when(titled, "figure_title").when(F.col("p") % 5 == 1, "vision_footnote").otherwise("text")
    content = F.when(titled, F.concat(F.lit("Figure "), "block", F.lit(". Of it"))).otherwise(F.repeat(F.lit("word "), (F.col("p") % 40).cast("int")))
    left, top = (F.col("p") % 2) * 400.0 + 50, F.col("block") * 100.0 + (F.col("s") % 4) * 25
    blocks = lines.select("doc", "page", "block", label.alias("label"), content.alias("content"),
                          F.lit(None).cast("string").alias("parent"), left.alias("left"), top.alias("top"), (left + 300).alias("right"), (top + 90).alias("bottom"))
    return blocks, blocks.filter("label = 'figure_title'").select("doc", "page", F.col("block").alias("caption"), F.lit("figure").alias("kind"))


@query(f"""WITH b AS ({_BLOCKS}), v AS (SELECT * FROM b WHERE label = 'image'), c AS (SELECT * FROM b WHERE label = 'figure_title'),
p AS (SELECT v.doc, v.page, v.block AS visual, c.block AS caption, v.l AS vl, v.t AS vt, least(v.l, c.l) AS l, least(v.t, c.t) AS t, greatest(v.l, c.l) + 300 AS r, greatest(v.t, c.t) + 90 AS o
  FROM v JOIN c ON v.doc = c.doc AND v.page = c.page)
SELECT doc, page, visual, caption FROM p WHERE EXISTS (SELECT 1 FROM b x WHERE x.doc = p.doc AND x.page = p.page AND x.block <> p.caption AND x.block <> p.visual AND x.label IN ('text', 'figure_title')
  AND x.l < p.r AND p.l < x.l + 300 AND x.t < p.o AND p.t < x.t + 90
  AND NOT (x.l = p.vl AND x.t = p.vt) AND NOT (length(x.content) <= 80 AND NOT starts_with(x.content, 'Figure') AND x.l < p.vl + 300 AND p.vl < x.l + 300 AND x.t < p.vt + 90 AND p.vt < x.t + 90))""")
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, captions = _blocks(spark, sf_dir)
    visuals = blocks.filter("label = 'image'").select("doc", "page", F.col("block").cast("string").alias("candidate"), "block")
    return figures.blocked_pairs(visuals, captions, blocks).select("doc", "page", F.col("candidate").cast(dict(blocks.dtypes)["block"]).alias("visual"), "caption")


@query()
def figure_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's visuals with the captions they get, those of neighbouring pages among them."""
    blocks, captions = _blocks(spark, sf_dir)
    return figures.assignments(blocks, captions)


@query("""WITH o AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 3 AS kind FROM orders),
f AS (SELECT doc, page FROM o WHERE kind = 0), c AS (SELECT doc, page FROM o WHERE kind = 1),
p AS (SELECT f.doc, f.page, c.page AS caption_page FROM f JOIN c ON f.doc = c.doc AND abs(f.page - c.page) = 1),
n AS (SELECT *, count(*) OVER (PARTITION BY doc, page) AS a, count(*) OVER (PARTITION BY doc, caption_page) AS b FROM p)
SELECT doc, page, caption_page FROM n WHERE a = 1 AND b = 1""")
def cross_page_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages with one figure, one caption, or one block of text that is in the way of neither."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    kind = F.col("o_orderkey") % 3
    label = F.when(kind == 0, "image").when(kind == 1, "figure_title").otherwise("text")
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), number.cast("long").alias("page"), F.lit(1).alias("block"), label.alias("label"), F.when(kind == 1, "Figure 1. It").otherwise("").alias("content"),
                                                   F.lit(None).cast("string").alias("parent"), F.lit(50.0).alias("left"), F.lit(100.0).alias("top"), F.lit(350.0).alias("right"), F.lit(190.0).alias("bottom"))
    captions = blocks.filter("label = 'figure_title'").select("doc", "page", F.col("block").alias("caption"), F.lit("figure").alias("kind"))
    return figures.cross_page_owners(blocks, captions).select("doc", "page", "caption_page")
