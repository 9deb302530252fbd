"""Proportional stratified interleaving: shards whose mixture of sources equals the corpus's.

Rows of a source are put in a seeded random order and given the fractional rank ``(rank - phase) / rows of the source``.
Sorted by that fraction, every stretch of the whole order holds each source in proportion, so equal cuts are shards that
match the mixture to within a row or two of a source. Sources with fewer rows than there are shards share one stratum, so
that many of them, each at a place by chance, don't crowd a shard. Ranks are found without gathering a source in one task: the seeded order
key is a uniform hash, so its leading bits cut each source into buckets of known size; a row's rank is its bucket's offset
plus its place in the bucket. The fraction is bucketed the same way. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.tables import stored

#: Rows that one bucket of an order is meant to hold, and the most buckets (of each source) there are.
BUCKET_ROWS, MAX_BUCKETS = 500, 16_384
#: The most sources too small for a stratum of their own that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
#: The stratum that they share; own strata begin with "=", and the rows without a source are stratum "".
POOL = "*"


def _unit(hexed: Column) -> Column:
    """The first 32 bits of a hex digest as a number from 0 to 1."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def interleave(docs: DataFrame, n_shards: int = 24, seed: str = "0", text: str = "text", key: str = "doc_id",
               source: str = "source", own_stratum_rows: int | None = None) -> DataFrame:
    """Return key, size, text_crc32, source, position, shard and slot of every row.

    size is the UTF-8 bytes of the text plus 8. Shards' row counts differ by at most one. Nulls: a null text has no bytes
    and checksum 0 (that of no bytes), a null source is a stratum of its own, a null key is ordered like the empty key.
    Rows that agree in key, text and source are interchangeable; each still gets its own slot. An empty table gives no
    rows. With fewer rows than shards, some shards are empty. Very long texts count whole. Other columns are ignored, whatever their
    names. own_stratum_rows: sources of fewer rows share a stratum; by default those that could not reach every shard.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("stratum"),
        (F.octet_length(content) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).cast("long").alias("text_crc32"),
    ).withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("text_crc32")).cast("binary")))
    rows = stored(rows, "narrow")  # texts are read once; what follows works on these few columns
    small = stored(rows.filter("stratum <> ''").groupBy("stratum").agg(F.count("*").alias("n")).filter(F.col("n") < (n_shards if own_stratum_rows is None else own_stratum_rows)).select("stratum", F.lit(POOL).alias("pool")), "small")
    n_small = small.count()
    rows = rows.withColumn("own", F.col("stratum"))
    if n_small:
        rows = rows.join(F.broadcast(small) if n_small <= MAX_BROADCAST else small, "stratum", "left").withColumn("stratum", F.coalesce("pool", "stratum")).drop("pool")
    total = rows.count()
    buckets = max(1, min(MAX_BUCKETS, total // BUCKET_ROWS))
    bucketed = rows.withColumn("bucket", F.floor(_unit(F.col("order")) * buckets).cast("int"))

    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum")
    counts = bucketed.groupBy("stratum", "bucket").agg(F.count("*").alias("here")).select(
        "stratum", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"), F.sum("here").over(whole).alias("of_source"))
    inside = Window.partitionBy("stratum", "bucket").orderBy("order", "key", "size")
    ranked = bucketed.withColumn("rank", F.row_number().over(inside)).join(counts, ["stratum", "bucket"]).select(
        "key", "own", "stratum", "size", "text_crc32", "order",
        ((F.col("offset") + F.col("rank") - _unit(F.md5(F.col("stratum").cast("binary")))) / F.col("of_source")).alias("fraction"))

    placed = ranked.withColumn("slice", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("int"))
    # One row a slice, so this running sum has as many rows as there are buckets, not documents.
    offsets = placed.groupBy("slice").agg(F.count("*").alias("here")).select(
        "slice", F.coalesce(F.sum("here").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("slice").orderBy("fraction", "stratum", "order", "key", "size")
    position = (F.col("start") + F.row_number().over(inside) - 1).cast("long")
    shard = F.expr(f"cast((position * {n_shards}) div {max(1, total)} as int)")
    first = F.expr(f"(shard * {max(1, total)} + {n_shards - 1}) div {n_shards}")
    return placed.join(offsets, "slice").withColumn("position", position).withColumn("shard", shard).select(
        F.col("key").alias(key), "size", "text_crc32", F.when(F.col("own") != "", F.substring("own", 2, 1 << 30)).alias("source"),
        "position", "shard", (F.col("position") - first).cast("long").alias("slot"))

