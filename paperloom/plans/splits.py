"""The query over blocks that are cut at captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import splits
from paperloom.plans.registry import query, table


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, text, unnest([0, n // 3, n // 2, n - n // 8]) AS a, unnest([n // 3, n // 2, n - n // 8, n]) AS e, unnest(['text', 'figure_title', 'text', 'figure_title']) AS label FROM d WHERE n >= 100),
p AS (SELECT doc_id, a, label, regexp_replace(substr(text, a + 1, e - a), '^\\s+|\\s+$', '', 'g') AS piece FROM r),
w AS (SELECT doc_id, a, label, piece FROM p WHERE piece <> '' UNION ALL SELECT doc_id, NULL, 'text', text FROM d WHERE n < 100)
SELECT doc_id, '0:' || a AS part_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS part, label, length(piece) AS n_chars, sha256(piece) AS digest FROM w""")
def split_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as blocks; a caption stands from a third to a half and in the last eighth, and one that overlaps the first is passed over."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    blocks = docs.select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), F.lit("0").alias("block"), F.lit("text").alias("label"), F.col("text").alias("content"))
    n = F.length("content")
    places = [(F.floor(n / 3), F.floor(n / 2)), (F.floor(n / 3) + 5, F.floor(n / 2) + 5), (n - F.floor(n / 8), n)]
    held = F.explode(F.array(*(F.struct(a.cast("int").alias("start"), e.cast("int").alias("end")) for a, e in places)))
    refs = blocks.filter(n >= 100).select("doc", "page", "block", "content", held.alias("p")).select("doc", "page", "block", "p.*", F.substr("content", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("text"))
    out = splits.split_captions(blocks, refs)
    return out.select(F.col("doc").alias("doc_id"), "part_id", F.col("part").cast("long").alias("part"), "label", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("digest"))
