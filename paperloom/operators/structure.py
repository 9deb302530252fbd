"""Document structure above single blocks: assembled pages, text regions that continue elsewhere, line runs, proportional splits,
tables of figures, and paragraphs marked in Markdown. Groups are as large as a document or a page."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.places import cutting, let, overlaps, placed, replaced
from paperloom.operators.grouped import fold_groups

# Labels of running text, and the most that a continued region may jut out of its box.
BODY_LABELS = ("text", "paragraph", "abstract", "list")
TOLERANCE, FILLED = 4.0, 0.7


def assembled_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc, ordinal, markdown, images: name to address) in order: page (from 0), markdown and images. The first address of a
    name keeps it; others are renamed p<page>_<name>, in the page's Markdown as well."""
    numbered = pages.withColumn("page", F.row_number().over(Window.partitionBy("doc").orderBy("ordinal")) - 1)
    one = numbered.select("doc", "page", F.explode("images").alias("name", "address"))
    first = F.first("address").over(Window.partitionBy("doc", "name").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    named = one.withColumn("new", F.when(F.col("address") == first, F.col("name")).otherwise(F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_"), "name")))
    by_page = named.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("name", "new", "address"))).alias("_i"))
    joined = numbered.join(by_page, ["doc", "page"], "left")
    changed = F.filter("_i", lambda x: x["name"] != x["new"])
    text = F.when(F.col("_i").isNull(), F.coalesce("markdown", F.lit(""))).otherwise(
        F.aggregate(changed, F.coalesce("markdown", F.lit("")), lambda md, x: F.replace(md, x["name"], x["new"])))
    images = F.when(F.col("_i").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.transform("_i", lambda x: F.struct(x["new"], x["address"]))))
    return joined.select("doc", "page", text.alias("markdown"), images.alias("images"))


def _shares(rows: list[dict]) -> list[tuple]:
    """Regions of one document's text blocks. Blocks of a group across pages are one lot, any other block is a lot by itself; a lot
    belongs to the block in it that is filled, if there is one. A page's own group, in order, hands the lots in it that nobody owns to
    the owner of its filled block; a group that would bring two owners together hands nothing."""
    lot = [(r["label"], r["global_group"]) if r["global_group"] >= 0 else n for n, r in enumerate(rows)]
    full = [n for n, r in enumerate(rows) if (r["content"] or "").strip()]
    owners: dict = {}
    for n in full:
        owners.setdefault(lot[n], set()).add(n)
    own_groups: dict = {}
    for n, r in enumerate(rows):
        if r["local_group"] >= 0:
            own_groups.setdefault((r["page"], r["label"], r["local_group"]), []).append(n)
    filled = set(full)
    for group in own_groups.values():
        claims = set().union(*(owners.get(lot[n], ()) for n in group))
        if len(claims) == 1 and len(filled.intersection(group)) == 1:
            owners.update((lot[n], claims) for n in group)
    members: dict = {}
    for n, name in enumerate(lot):
        if len(who := owners.get(name, ())) == 1:
            members.setdefault(next(iter(who)), []).append(n)
    return [region for owner, own in members.items() if len(own) > 1 for region in _parts(rows, owner, own)]


def _parts(rows: list[dict], owner: int, members: list[int]) -> list[tuple]:
    """The members' boxes, each with its share of the owner's text by area; none if a box is incomplete."""
    boxes = [tuple(rows[n][side] for side in ("left", "top", "right", "bottom")) for n in members]
    if any(None in box for box in boxes):
        return []
    areas = [(right - left) * (bottom - top) for left, top, right, bottom in boxes]
    total, size = sum(areas), len(rows[owner]["content"])
    name = rows[owner]["doc"], rows[owner]["page"], rows[owner]["block"]
    return [(*name, part, rows[n]["page"], *box, max(1, int(size * area / total + 0.5) if total else 0)) for part, (n, box, area) in enumerate(zip(members, boxes, areas, strict=True))]


def text_regions(blocks: DataFrame) -> DataFrame:
    """Regions of text blocks (doc, page, ordinal, block, label, content, global_group, local_group, box) whose text stands in one block
    while others of its group are empty: (doc, page, block) of the filled one, and each region's page, box and share of the text by area.

    Groups across pages come first; a group within a page joins only if a single block of all it connects is filled.
    """
    rows = blocks.filter(F.col("label").isin(*BODY_LABELS)).select(
        "doc", F.col("page").cast("long"), F.col("ordinal").cast("long"), F.col("block").cast("string"), "label", "content",
        *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("global_group", "local_group")), *(F.col(c).cast("double") for c in ("left", "top", "right", "bottom")))
    kind = dict(rows.dtypes)["doc"]
    schema = f"doc {kind}, page long, block string, part long, region_page long, left double, top double, right double, bottom double, length long"
    return fold_groups(rows, ["doc"], ["page", "ordinal", "block"], _shares, schema)


def repaired_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (doc, block, part, region_page, box) with the page of the one empty block that they fit: of body blocks behind their
    own (doc, n: place in reading order, page, block, label, content, box) up to the next filled one, of the same label on a later page,
    and around the region but for TOLERANCE, filled to FILLED of its area. Several such, or none: the page stays."""
    body = blocks.filter(F.col("label").isin(*BODY_LABELS)).withColumn("_filled", ~T.is_blank(F.col("content")))
    after = Window.partitionBy("doc").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    owners = body.withColumn("_stop", F.min(F.when(F.col("_filled"), F.col("n"))).over(after)).select(
        "doc", "block", F.col("n").alias("_n"), F.col("page").alias("_page"), F.col("label").alias("_label"), "_stop")
    r = regions.join(owners, ["doc", "block"]).alias("r")
    e = body.filter("NOT _filled").alias("e")
    inside = ((F.col("r.left") >= F.col("e.left") - TOLERANCE) & (F.col("r.top") >= F.col("e.top") - TOLERANCE)
              & (F.col("r.right") <= F.col("e.right") + TOLERANCE) & (F.col("r.bottom") <= F.col("e.bottom") + TOLERANCE))

    def area(a: str) -> Column:
        return (F.col(f"{a}.right") - F.col(f"{a}.left")) * (F.col(f"{a}.bottom") - F.col(f"{a}.top"))

    fits = ((F.col("r.doc") == F.col("e.doc")) & (F.col("e.n") > F.col("r._n")) & (F.col("r._stop").isNull() | (F.col("e.n") < F.col("r._stop")))
            & (F.col("e.label") == F.col("r._label")) & (F.col("e.page") > F.col("r._page")) & (F.col("r.region_page") > F.col("r._page")) & inside & (area("r") >= area("e") * FILLED))
    one = r.join(e, fits).groupBy(F.col("r.doc").alias("doc"), F.col("r.block").alias("block"), F.col("r.part").alias("part")).agg(F.count("*").alias("_k"), F.min("e.page").alias("_to")).filter("_k = 1").drop("_k")
    return regions.join(one, ["doc", "block", "part"], "left").withColumn("region_page", F.coalesce("_to", "region_page")).drop("_to").select(*regions.columns)


def _line_runs(rows: list[dict]) -> list[tuple]:
    """Boxes of one page merged: those that overlap vertically by half are a band; neighbours in a band with a small gap are one line."""
    boxes = sorted({(r["left"], r["top"], r["right"], r["bottom"]) for r in rows}, key=lambda b: (b[1], b[0], b[2], b[3]))
    bands: list[tuple[list[float], list[tuple]]] = []

    def grown(a, b):
        return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]

    for b in (b for b in boxes if b[2] > b[0] and b[3] > b[1]):
        home = None
        for band in reversed(bands):
            if band[0][3] < b[1]:
                break
            if min(band[0][3], b[3]) - max(band[0][1], b[1]) > 0.5 * min(band[0][3] - band[0][1], b[3] - b[1]):
                home = band
                break
        if home is None:
            bands.append((list(b), [b]))
        else:
            home[0][:] = grown(home[0], b)
            home[1].append(b)
    lines = []
    for _, members in bands:
        members.sort(key=lambda b: b[0])
        line = list(members[0])
        for b in members[1:]:
            if b[0] - line[2] <= 0.6 * min(b[3] - b[1], line[3] - line[1]):
                line = grown(line, b)
            else:
                lines.append(line)
                line = list(b)
        lines.append(line)
    return [(rows[0]["doc"], rows[0]["page"], n, *line) for n, line in enumerate(lines)]


def line_runs(boxes: DataFrame) -> DataFrame:
    """(doc, page, line, box): character boxes (doc, page, left, top, right, bottom) as runs of lines, none across columns or paragraphs."""
    rows = boxes.dropna(subset=["left", "top", "right", "bottom"]).select("doc", F.col("page").cast("long"), *(F.col(c).cast("double") for c in ("left", "top", "right", "bottom")))
    kind = dict(rows.dtypes)["doc"]
    return fold_groups(rows, ["doc", "page"], ["top", "left"], _line_runs, f"doc {kind}, page long, line long, left double, top double, right double, bottom double")


def proportional_ranges(text: Column, weights: Column) -> Column:
    """array of (start, end): a text cut by weights (at least 1 each). A cut that falls into a formula moves behind it; the last range
    takes what is left."""
    w = F.transform(weights, lambda x: F.greatest(x.cast("long"), F.lit(1)))
    total = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + x)
    formula = r"\$[^$\n]+\$|\\\([\s\S]*?\\\)"
    kind = "array<struct<start: int, end: int>>"

    def split(whole: Column) -> Column:
        size, formulas = whole["size"], whole["formulas"]

        def step(s: Column, x: Column) -> Column:
            n, weight = s["n"] + 1, s["weight"] + x
            even = F.greatest(F.least(F.floor(size * weight / whole["total"] + 0.5).cast("int"), size), s["upto"])
            cut = F.when(n == whole["parts"], size).otherwise(even)
            end = F.aggregate(formulas, cut, lambda e, f: F.when((e > f["start"]) & (e < f["end"]), f["end"]).otherwise(e))
            return F.struct(n.alias("n"), weight.alias("weight"), end.alias("upto"), F.concat(s["out"], F.array(F.struct(s["upto"].alias("start"), end.alias("end")))).alias("out"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("weight"), F.lit(0).alias("upto"), F.array().cast(kind).alias("out"))
        return F.aggregate(w, zero, step, lambda s: s["out"])

    return let(F.struct(F.length(text).alias("size"), placed(text, formula).alias("formulas"), total.alias("total"), F.size(w).alias("parts")), split)


def figure_tables(figures: DataFrame, blocks: DataFrame, version: Column) -> DataFrame:
    """Per figure (doc, figure, source_version, refs: array of (page, block)): stale (made from another version), incomplete (a block is
    missing or an empty table), and content, its table and chart blocks in order. Of a stale figure nothing is read."""
    stale = F.col("source_version").isNotNull() & (F.col("source_version") != version)
    f = figures.withColumn("stale", F.coalesce(stale, F.lit(False)))
    refs = f.filter("NOT stale").select("doc", "figure", F.explode(F.array_distinct("refs")).alias("r")).select("doc", "figure", F.col("r.page").alias("page"), F.col("r.block").alias("block"))
    b = blocks.select("doc", "page", "block", "label", "content")
    joined = refs.join(b, ["doc", "page", "block"], "left")
    table = F.col("label").isin("table", "chart")
    found = joined.groupBy("doc", "figure").agg(
        F.bool_or(F.col("label").isNull() | (table & T.is_blank(F.col("content")))).alias("incomplete"),
        F.array_sort(F.collect_list(F.when(table & ~T.is_blank(F.col("content")), F.struct("page", "block", T.strip(F.col("content")).alias("content"))))).alias("_c"))
    out = f.select("doc", "figure", "stale").join(found, ["doc", "figure"], "left")
    return out.select("doc", "figure", "stale", F.coalesce("incomplete", F.lit(False)).alias("incomplete"),
                      F.coalesce(F.transform("_c", lambda c: c["content"]), F.array().cast("array<string>")).alias("content"))


def heading_levels(md: Column, titles: Column) -> Column:
    """Headings whose text, with or without a number before it, is one of the titles become level two."""
    heading = r"^(#{1,6})\s+(.+?)(?:\s+#+\s*)?$"

    def line(s: Column) -> Column:
        text = T.strip(F.regexp_extract(s, heading, 2))
        bare = F.regexp_replace(text, r"(?i)^(?:\d+(?:\.\d+)*|[ivxlcdm]+)\s*[:.)\-]?\s+", "")
        known = F.array_contains(titles, text) | F.array_contains(titles, bare)
        return F.when(s.rlike(heading) & (F.regexp_extract(s, heading, 1) != "##") & F.coalesce(known, F.lit(False)), F.concat(F.lit("## "), text)).otherwise(s)

    return F.array_join(F.transform(F.split(md, "\n", -1), line), "\n")


def marked_paragraphs(md: Column, paragraphs: Column) -> Column:
    """Markdown with comments around the paragraphs that have an id: an array of (start, end, text, id) in order. Those without an
    id, that overlap one before, or whose text has changed, are passed over. Ids are base64 with the URL's letters."""
    def apart(fitting: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            return F.struct(F.when(p["start"] >= s["upto"], p["end"]).otherwise(s["upto"]).alias("upto"), F.concat(s["keep"], F.array(p["start"] >= s["upto"])).alias("keep"))

        keep = F.aggregate(fitting, F.struct(F.lit(0).alias("upto"), F.array().cast("array<boolean>").alias("keep")), step, lambda s: s["keep"])
        return F.transform(F.filter(F.zip_with(fitting, keep, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda x: x["k"]), lambda x: x["p"])

    def marked(p: Column) -> Column:
        key = F.translate(F.base64(F.encode(p["id"], "UTF-8")), "+/", "-_")
        return F.concat(F.lit("\n\n<!-- reader-pair:"), key, F.lit(" -->\n\n"), p["text"], F.lit("\n\n<!-- reader-end -->\n\n"))

    fitting = cutting(md, lambda cut: F.filter(paragraphs, lambda p: F.coalesce(p["id"].isNotNull() & (p["end"] > p["start"]) & (cut(p["start"], p["end"]) == p["text"]), F.lit(False))))
    return let(let(fitting, apart), lambda kept: replaced(md, kept, marked))


# Glyphs that stand for letters or plain quotes, what counts for nothing, and formulas within a line.
GLYPHS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "‘": "'", "’": "'", "“": '"', "”": '"'}
IGNORED = re.compile(r"[\s\u00ad-]")
LINE_FORMULA = re.compile(r"\$[^$\n]+\$|\\\([\s\S]*?\\\)")


_IGNORED_POINTS = np.array([n for n in range(0x3001) if IGNORED.match(chr(n))], np.uint32)
_FOLDED_POINTS = np.array(sorted(map(ord, GLYPHS)), np.uint32)


def _glyphs(text: str, without: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters that count, and the place in the text that each comes from."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = ~np.isin(points, _IGNORED_POINTS)
    for start, end in without:
        counts[start:end] = False
    where = np.flatnonzero(counts)
    points = points[where]
    if np.isin(points, _FOLDED_POINTS).any():
        new = [GLYPHS.get(chr(p), chr(p)) for p in points]
        where = np.repeat(where, [len(n) for n in new])
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points.astype(np.int64), where


def _common(a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[int, int]] | None:
    """Pairs of a longest common subsequence, taken from the front; None if it is less than that part of the shorter one.

    best(i, k) is the length of that of a[i:] and b[k:]. A row is one integer: its bit k from the end of b is set where best(i, k) is one
    more than best(i, k + 1), so a row follows from the one below in a few operations on whole integers, and the bits of a row that are
    left of the end count up to best."""
    n = len(b)
    at = {p: int.from_bytes(np.packbits(b[::-1] == p, bitorder="little").tobytes(), "little") for p in np.unique(a).tolist()}
    whole = (1 << n) - 1
    rows, still = [0], whole  # still: the bits that are not set
    for p in a.tolist()[::-1]:
        hit = still & at[p]
        still = ((still + hit) | (still - hit)) & whole
        rows.append(whole ^ still)
    rows.reverse()
    if rows[0].bit_count() < least * min(len(a), n):
        return None
    a, b = a.tolist(), b.tolist()
    out, i, k = [], 0, 0
    here, below = rows[0].bit_count(), rows[1].bit_count()  # best(i, k) and best(i + 1, k)
    size = n + 7 >> 3
    upper, lower = (rows[i].to_bytes(size, "little") for i in (0, 1))  # a bit of them is found in one step
    while i < len(a) and k < n:
        met = a[i] == b[k]
        if met:
            out.append((i, k))
        down, right = met or here == below, met or here != below
        if right:
            bit = n - 1 - k
            here, below = here - (upper[bit >> 3] >> (bit & 7) & 1), below - (lower[bit >> 3] >> (bit & 7) & 1)
            k += 1
        if down:
            i += 1
            if i < len(a):
                here, below = below, (rows[i + 1] & (1 << n - k) - 1).bit_count()
                upper, lower = lower, rows[i + 1].to_bytes(size, "little")
    return out


def aligned(value: str, printed: str, least: float = 0.7, most_cells: int = 9_000_000) -> tuple[list[int], list[tuple[int, int, int, int]]] | None:
    """For each character of a recognised text its place in the printed one, -1 where it has none; and for each formula its start and end
    and the printed stretch (start, end) between its neighbours, which its parts have no places in.

    Blanks and hyphens count for nothing, ligatures and quotes are folded, formulas are left out. An exact occurrence comes first,
    else a longest common subsequence; None if less than `least` of the shorter text agrees, one has no letters, or the table of the
    subsequence would have more than most_cells cells."""
    formulas = [m.span() for m in LINE_FORMULA.finditer(value)]
    (a, where_a), (b, where_b) = _glyphs(value, formulas), _glyphs(printed, [])
    if not len(a) or not len(b):
        return None
    at = "".join(map(chr, b.tolist())).find("".join(map(chr, a.tolist())))
    if at >= 0:
        pairs = [(i, at + i) for i in range(len(a))]
    elif (len(a) + 1) * (len(b) + 1) > most_cells or (pairs := _common(a, b, least)) is None:
        return None
    out = [-1] * len(value)
    from_a, to_b = where_a.tolist(), where_b.tolist()
    for i, k in pairs:
        out[from_a[i]] = to_b[k]
    stretches = []
    for start, end in formulas:
        before, behind = (bisect_left(pairs, place, key=lambda p: where_a[p[0]]) for place in (start, end))
        low = pairs[before - 1][1] + 1 if before else 0
        high = pairs[behind][1] if behind < len(pairs) else len(b)
        if low < high:
            stretches.append((start, end, int(where_b[low]), int(where_b[high - 1]) + 1))
    return out, stretches


def alignments(rows: DataFrame, key: str, value: str, printed: str) -> DataFrame:
    """(key, places, formulas) by `aligned` for each row; both are null where there is no alignment."""
    names = ("start", "end", "from", "upto")

    def placed_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [aligned(v, p) if v is not None and p is not None else None for v, p in zip(part["v"], part["p"], strict=True)]
            yield pd.DataFrame({"k": part["k"], "places": [f and f[0] for f in found], "formulas": [f and [dict(zip(names, x, strict=True)) for x in f[1]] for f in found]})

    kind = dict(rows.dtypes)[key]
    schema = f"k {kind}, places array<int>, formulas array<struct<start: int, end: int, `from`: int, upto: int>>"
    return rows.select(F.col(key).alias("k"), F.col(value).alias("v"), F.col(printed).alias("p")).mapInPandas(placed_rows, schema).withColumnRenamed("k", key)


def quote_boxes(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, boxes) of the quotes that occur once on their page (white space aside): the boxes of their letters, merged by line.

    pages: page, text, and glyphs, an array of boxes (left, top, right, bottom), one for each character; null or without an area where
    nothing is drawn. quotes: id, page, quote, and within, a box (or null) that every letter's centre must lie in, give or take 2.
    Occurrences do not overlap; those of which nothing is drawn, or that leave the box, do not count. Quotes without a letter, of
    unknown pages, or that occur twice have no row."""
    drawn = lambda b: (b["right"] > b["left"]) & (b["bottom"] > b["top"])
    letters = F.filter(F.zip_with(F.split("text", ""), "glyphs", lambda c, b: F.struct(c.alias("c"), b.alias("b"))), lambda x: x["c"].isNotNull() & ~x["c"].rlike(r"^\s*$"))
    flat = pages.select("page", F.regexp_replace("text", r"\s+", "").alias("flat"), F.transform(letters, lambda x: x["b"]).alias("boxes"))
    wanted = quotes.select("id", "page", F.regexp_replace("quote", r"\s+", "").alias("needle"), "within").filter("needle <> ''")
    # Quotes are hashed by page, so pages with their boxes are neither sorted nor, where they are dealt by page already, moved.
    joined = flat.join(wanted.hint("shuffle_hash"), "page").filter(F.contains("flat", F.col("needle")))

    def centred(b: Column) -> Column:
        x, y, w = (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2, F.col("within")
        return F.col("within").isNull() | ((x >= w["left"] - 2) & (x < w["right"] + 2) & (y >= w["top"] - 2) & (y < w["bottom"] + 2))

    quoted = F.concat(F.lit("\\Q"), F.replace("needle", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    own = lambda p: F.filter(F.slice(F.col("boxes"), p["start"] + 1, p["end"] - p["start"]), lambda b: F.coalesce(drawn(b), F.lit(False)))
    found = F.filter(F.transform(placed(F.col("flat"), quoted), own), lambda boxes: (F.size(boxes) > 0) & F.forall(boxes, centred))
    once = joined.select("id", found.alias("found")).filter(F.size("found") == 1)
    return once.select("id", merged_lines(F.get("found", F.lit(0))).alias("boxes"))


def merged_lines(boxes: Column) -> Column:
    """Boxes of letters in reading order as one box a line: a letter whose middle lies between its line's edges widens the line."""
    kind = "struct<left: double, top: double, right: double, bottom: double>"

    def step(lines: Column, b: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        middle = (b["top"] + b["bottom"]) / 2
        wider = F.struct(F.least(last["left"], b["left"]).alias("left"), F.least(last["top"], b["top"]).alias("top"), F.greatest(last["right"], b["right"]).alias("right"),
                         F.greatest(last["bottom"], b["bottom"]).alias("bottom")).cast(kind)
        same = (F.size(lines) > 0) & (middle > last["top"]) & (middle < last["bottom"])
        return F.when(same, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(wider))).otherwise(F.concat(lines, F.array(b.cast(kind))))

    return F.aggregate(boxes, F.array().cast(f"array<{kind}>"), step)


def bound_paragraphs(views: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, id, language, start, end): where each paragraph stands in the rendered text of its document.

    views: doc, text. entries: doc, n (their order), id, language, text, and start and end of the stretch marked as theirs (or null).
    Places count characters that are neither blank nor a dollar sign. A paragraph that occurs once in its marked stretch is there. Of the
    others, those with equal text are paired in order with its occurrences outside what is taken, if they are as many; else none has
    a place."""
    compact = lambda c: F.regexp_replace(c, r"[\s$]+", "")
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    flat = views.select("doc", compact(F.col("text")).alias("flat"))
    rows = entries.select("doc", "n", "id", "language", compact(F.col("text")).alias("key"), "start", "end").filter("key <> ''").join(flat, "doc")
    marked = F.substr("flat", F.col("start") + 1, F.col("end") - F.col("start"))
    at = F.instr(marked, F.col("key")) - 1
    once = F.col("start").isNotNull() & (at >= 0) & ~F.contains(F.substr(marked, at + 2), F.col("key"))
    rows = rows.withColumn("at", F.when(once, F.col("start") + at))
    sure = rows.filter("at IS NOT NULL").select("doc", "id", "language", F.col("at").alias("start"), (F.col("at") + F.length("key")).alias("end"))
    taken = sure.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("taken"))
    # Texts are looked for once, however many paragraphs share them.
    groups = rows.filter("at IS NULL").groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("n", "id", "language"))).alias("group"), F.first("flat").alias("flat"))
    hits = F.transform(placed(F.col("flat"), quoted(F.col("key"))), lambda p: F.struct(p["start"].alias("start"), (p["start"] + 1).alias("end")))
    free = groups.join(taken, "doc", "left").select("group", "doc", F.length("key").alias("size"), hits.alias("hits"), F.coalesce("taken", F.array().cast("array<struct<start: int, end: int>>")).alias("taken"))
    free = free.withColumn("hits", F.filter(F.zip_with("hits", overlaps(F.col("hits"), [F.col("taken")]), lambda h, o: F.when(o.isNull(), h)), lambda h: h.isNotNull()))
    paired = free.filter(F.size("hits") == F.size("group")).select("doc", "size", F.explode(F.zip_with("group", "hits", lambda g, h: F.struct(g.alias("g"), h["start"].alias("start")))).alias("x"))
    return sure.unionByName(paired.select("doc", "x.g.id", "x.g.language", "x.start", (F.col("x.start") + F.col("size")).alias("end")))
