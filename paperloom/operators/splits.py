"""Blocks that hold captions amid other text, cut into blocks of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators.grouped import fold_groups

KEYS = ["doc", "page", "block"]


def _apart(rows: list[dict]) -> list[tuple]:
    """Of one block's ranges in order, those that begin where the last one taken has ended."""
    out, reached = [], 0
    for r in rows:
        if r["start"] >= reached:
            out.append(tuple(r[c] for c in (*KEYS, "start", "end")))
            reached = r["end"]
    return out


def split_captions(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc, page, block, part, part_id, label, content) of every block (doc, page, block, label, content; an id once a page).

    refs: (doc, page, block, start, end, text) of captions in blocks, in code points. One whose text is not what the block holds there is passed
    over; of overlapping ones the first stays (of those that begin together, the shorter). A block with a caption and other text is cut
    before and behind each caption: captions become figure_title, the rest keeps its label, blank pieces go, pieces are trimmed, and a
    piece's part_id is the block's with the place where it began. Other blocks stay as they are, with null part_id and part 0."""
    b = blocks.select(*KEYS, "label", "content")
    body = F.coalesce("content", F.lit(""))
    valid = refs.select(*KEYS, "start", "end", "text").distinct().join(b, KEYS)
    valid = valid.filter((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length(body)) & (F.substr(body, F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")))
    outside = F.concat(F.substr(body, F.lit(1), F.col("start")), F.substr(body, F.col("end") + 1, F.length(body)))
    mixed = valid.withColumn("other", ~T.is_blank(outside)).select(*KEYS, "start", "end", F.max("other").over(Window.partitionBy(*KEYS)).alias("cut")).filter("cut").drop("cut")
    types = dict(mixed.dtypes)
    kept = fold_groups(mixed, KEYS, ["start", "end"], _apart, ", ".join(f"{c} {types[c]}" for c in (*KEYS, "start", "end")))
    order = Window.partitionBy(*KEYS).orderBy("start")
    spans = kept.withColumn("before", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("last", F.lead("end").over(order).isNull())
    span = lambda start, end, caption: F.struct(F.col(start).cast("int").alias("start"), end.cast("int").alias("end"), F.lit(caption).alias("caption"))
    tail = F.when(F.col("last"), span("end", F.lit(None), False))
    ranges = F.filter(F.array(span("before", F.col("start"), False), span("start", F.col("end"), True), tail), lambda r: r.isNotNull())
    cut = spans.select(*KEYS, F.explode(ranges).alias("r")).join(b, KEYS)
    text = T.strip(F.substr(body, F.col("r.start") + 1, F.coalesce("r.end", F.length(body)) - F.col("r.start")))
    cut = cut.select(*KEYS, F.concat_ws(":", F.col("block").cast("string"), F.col("r.start")).alias("part_id"), F.when(F.col("r.caption"), "figure_title").otherwise(F.col("label")).alias("label"), text.alias("content"), F.col("r.start").alias("at"))
    cut = cut.filter("content <> ''").withColumn("part", F.row_number().over(Window.partitionBy(*KEYS).orderBy("at")) - 1)
    whole = b.join(kept.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS, F.lit(0).alias("part"), F.lit(None).cast("string").alias("part_id"), "label", "content")
    return whole.unionByName(cut.drop("at"))
