"""The region of a page that a figure takes: its members, grown into free space away from its caption, without any caption.

Segments are rows (doc, page, figure, block), a row for each block of a figure, its captions among them; blocks are those of
``figures``. Only pages of figures are looked at; each is gathered once, and meets its figures by one equi-join on document and page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators.figures import is_blocker, is_part, union
from paperloom.operators.layout import MARGIN, SIDES, TEXT_LABELS, VISUAL_LABELS, blocks_of, paged

# The least free space that is taken, in pixels and in parts of the figure's size, what stays free at its end and at a
# caption, and labels of annotations that belong to a figure.
FREE, FREE_SHARE, SPARE = 80.0, 0.3, 8.0
ANNOTATIONS, NOTES = ("figure_annotation",), ("vision_footnote", "vision_footer")
#: Ways from the caption to the figure; the first of equal ones is taken.
WAYS = ("above", "below", "left", "right")


def _beyond(box: Column, other: Column) -> dict[str, Column]:
    """By way: how far box lies from other in it; not negative if they are apart."""
    return {"above": other["top"] - box["bottom"], "below": box["top"] - other["bottom"], "left": other["left"] - box["right"], "right": box["left"] - other["right"]}


def _level(a: Column, b: Column) -> dict[str, Column]:
    """By way: whether the boxes share a stretch across it."""
    across = (a["left"] < b["right"]) & (b["left"] < a["right"])
    along = (a["top"] < b["bottom"]) & (b["top"] < a["bottom"])
    return {"above": across, "below": across, "left": along, "right": along}


def _by_way(way: Column, values: dict[str, Column]) -> Column:
    out = F.when(way == WAYS[0], values[WAYS[0]])
    for name in WAYS[1:]:
        out = out.when(way == name, values[name])
    return out


def _way(caption: Column, column: Column, visuals: Column) -> Column:
    """Where most of the area of visuals lies: above or below the caption in its column, or beside it at its height."""
    reach = F.struct(column["left"].alias("left"), column["right"].alias("right"), caption["top"].alias("top"), caption["bottom"].alias("bottom"))

    def area(way: str) -> Column:
        there = F.filter(visuals, lambda v: _level(v, reach)[way] & (_beyond(v, caption)[way] >= 0))
        return F.aggregate(there, F.lit(0.0), lambda n, v: n + F.greatest((v["right"] - v["left"]) * (v["bottom"] - v["top"]), F.lit(0.0)))

    return F.array_max(F.array(*(F.struct(area(w).alias("area"), F.lit(-n).alias("n"), F.lit(w).alias("way")) for n, w in enumerate(WAYS))))["way"]


def _grown(base: Column, way: Column, caption: Column, blockers: Column, page_right: Column, page_bottom: Column) -> Column:
    """base up to the nearest blocker away from the caption (or the page's end), if there is enough space in between."""
    ends = {"above": base["top"], "below": page_bottom - base["bottom"], "left": base["left"], "right": page_right - base["right"]}

    def space(w: str) -> Column:
        met = F.filter(blockers, lambda b: _level(b, base)[w] & (_beyond(b, base)[w] > 0))
        return F.least(ends[w], F.array_min(F.transform(met, lambda b: _beyond(b, base)[w])))

    size = F.when(way.isin("above", "below"), base["bottom"] - base["top"]).otherwise(base["right"] - base["left"])
    free = _by_way(way, {w: space(w) for w in WAYS})
    take = (_by_way(way, _beyond(base, caption)) >= 0) & (size > 0) & (free >= FREE) & (free >= FREE_SHARE * size)
    by = F.when(take, free - SPARE).otherwise(0.0)
    moved = {"left": -F.when(way == "left", by).otherwise(0.0), "top": -F.when(way == "above", by).otherwise(0.0), "right": F.when(way == "right", by).otherwise(0.0), "bottom": F.when(way == "below", by).otherwise(0.0)}
    return F.struct(*((base[s] + moved[s]).alias(s) for s in SIDES))


def _trimmed(region: Column, captions: Column) -> Column:
    """The region cut back from each caption in turn, at the side where least is lost; a cut that would leave nothing is not made."""
    def cut(r: Column, c: Column) -> Column:
        wide, high = r["right"] - r["left"], r["bottom"] - r["top"]
        losses = [("top", wide * (c["bottom"] - r["top"])), ("bottom", wide * (r["bottom"] - c["top"])), ("left", high * (c["right"] - r["left"])), ("right", high * (r["right"] - c["left"]))]
        side = F.array_min(F.array(*(F.struct(x.alias("loss"), F.lit(n).alias("n"), F.lit(s).alias("side")) for n, (s, x) in enumerate(losses))))["side"]
        new = {"top": c["bottom"] + SPARE, "bottom": c["top"] - SPARE, "left": c["right"] + SPARE, "right": c["left"] - SPARE}
        left = {"top": new["top"] < r["bottom"], "bottom": new["bottom"] > r["top"], "left": new["left"] < r["right"], "right": new["right"] > r["left"]}
        met = _level(r, c)["above"] & _level(r, c)["left"]
        return F.struct(*(F.when(met & (side == s) & left[s], new[s]).otherwise(r[s]).alias(s) for s in SIDES))

    return F.aggregate(captions, region, cut)


def figure_regions(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, page, figure, way, left, top, right, bottom). way: where the figure lies from its caption, null without a caption.

    The caption is the figure's first usable title. The base is the union of its visuals and of those sub-labels, notes and annotations that
    lie on the figure's side of the caption; without a caption, of visuals, sub-labels and annotations; without any of these, of what
    is no caption and no note, or of all. It grows away from the caption up to the next blocker or the page's end if FREE pixels and
    FREE_SHARE of its size are free. Then captions are cut off. Members that repeat are one, those of no block are passed over."""
    label, content = F.col("label"), F.col("content")
    titled = (label == "figure_title") & T.is_usable_caption(content)
    named = segments.groupBy("page", "doc", "figure").agg(F.collect_set("block").alias("ids"))
    b = blocks.join(segments.select("page", "doc"), ["page", "doc"], "left_semi")
    b = b.withColumn("is_part", is_part(content)).withColumn("titled", F.coalesce(titled, F.lit(False))).withColumn("stops", F.coalesce(is_blocker(label, content), F.lit(False)))
    pages = paged(b, is_part=F.col("is_part"), titled=F.col("titled"), stops=F.col("stops"))

    def held(array: str, condition: Callable[[Column], Column], side: str | None = None) -> Column:
        found = F.filter(array, condition)
        return F.transform(found, lambda x: x[side]) if side else found

    visual, note = (lambda x: x["label"].isin(*VISUAL_LABELS)), (lambda x: x["label"].isin(*NOTES))
    middle = (F.col("page_left") + F.col("page_right")) / 2
    texts = lambda x: x["label"].isin(*TEXT_LABELS)
    f = pages.join(named, ["page", "doc"]).withColumn("members", held("blocks", lambda x: F.array_contains("ids", x["block"]))).filter(F.size("members") > 0)
    f = f.select("doc", "page", "figure", "members", "page_left", "page_right", "c.is_double", "c.left_right", "c.right_left", F.col("page_right").alias("p_right"), F.col("page_bottom").alias("p_bottom"),
                 held("blocks", visual).alias("p_visuals"), held("blocks", lambda x: x["stops"]).alias("p_blockers"),
                 F.array_min(held("blocks", lambda x: texts(x) & (x["right"] <= middle + MARGIN), "left")).alias("left_left"), F.array_max(held("blocks", lambda x: texts(x) & (x["left"] >= middle - MARGIN), "right")).alias("right_right"),
                 held("members", visual).alias("visuals"), held("members", lambda x: (x["is_part"] | x["label"].isin(*ANNOTATIONS)) & ~visual(x)).alias("parts"), held("members", lambda x: note(x) & ~x["is_part"]).alias("notes"),
                 held("members", lambda x: x["titled"]).alias("captions"), held("members", lambda x: ~x["titled"] & ~note(x)).alias("plain"))
    f = f.withColumn("c", F.get("captions", F.lit(0)))
    bounds = lambda left, right: F.struct(F.col(left).alias("left"), F.col(right).alias("right"))
    at_left, at_right = F.col("c.right") <= F.col("left_right") + MARGIN, F.col("c.left") >= F.col("right_left") - MARGIN
    crosses = (F.col("c.left") < F.col("left_right") + MARGIN) & (F.col("c.right") > F.col("right_left") - MARGIN)
    column = F.when(~F.col("is_double") | crosses, bounds("page_left", "page_right")).when(at_left, bounds("left_left", "left_right")).when(at_right, bounds("right_left", "right_right")).otherwise(bounds("page_left", "page_right"))
    known = F.col("c").isNotNull() & (F.size("visuals") + F.size("parts") > 0)
    f = f.withColumn("column", column).withColumn("way", F.when(known, _way(F.col("c"), F.col("column"), F.col("p_visuals"))))
    near = F.filter(F.concat("parts", "notes"), lambda m: _by_way(F.col("way"), _beyond(m, F.col("c"))) >= 0)
    f = f.withColumn("base", F.when(F.col("way").isNotNull(), union(F.concat("visuals", near))))
    f = f.withColumn("base", F.coalesce("base", union(F.concat("visuals", "parts")), union(F.col("plain")), union(F.col("members"))))
    ids = blocks_of(F.col("members"))
    f = f.withColumn("others", F.filter("p_blockers", lambda x: ~F.array_contains(ids, x["block"])))
    grown = F.when(F.col("way").isNotNull(), _grown(F.col("base"), F.col("way"), F.col("c"), F.col("others"), F.col("p_right"), F.col("p_bottom"))).otherwise(F.col("base"))
    f = f.withColumn("grown", grown).withColumn("region", _trimmed(F.col("grown"), F.col("captions")))
    return f.select("doc", "page", "figure", "way", *(F.col(f"region.{s}").alias(s) for s in SIDES))
