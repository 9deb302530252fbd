"""Connected components of a graph of long node ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.sources.scratch import forget, stored


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node it reaches, and has no row itself.

    edges: columns u and v, in any direction, repeated or not; loops and rows with a null are passed over. Each step is a
    minimum by node (combined before the shuffle) and a join back, so a node of very high degree is never gathered. Every
    round is written to the shared folder in place of the one before; the rounds end when the edges no longer change.
    """
    now = stored(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _digest(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, stored(small, "edges")
        forget(last)
        before, state = state, _digest(now)
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
