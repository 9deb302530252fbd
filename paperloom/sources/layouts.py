"""Readers of nested layouts (JSON trees whose depth is not known) and of the metadata inside PDF files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.sources.scratch import stored

# Where a node keeps its text, in this order; visual types; and what types are called.
CHILDREN = ("content", "item_content", "list_content", "list_items", "children")
VISUALS = ("chart", "image", "table")
RUNNING = ("list", "paragraph")
#: Levels of trees that one pass opens.
LEVELS = 6
#: Boxes are in thousandths of the page, and pages are shown at twice their points.
SCALE = 500.0


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def joined_text(trees: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of trees (keys, node: variant): all strings in order, blanks between, empty ones left out.

    A list's parts follow each other; an object's text is that of the first of CHILDREN that it has and that is not null; numbers and
    the like have none. A round opens LEVELS levels of every tree in one pass; it is written once, and what is left to open goes into the
    next round, so a string is written once however deep it lies. Trees without text have no row."""
    now, leaves = trees.filter("node IS NOT NULL").select(*keys, F.array().cast("array<int>").alias("path"), "node"), []
    while True:
        for _ in range(LEVELS):
            now = now.select(*keys, F.explode(_opened(F.col("path"), F.col("node"))).alias("x")).select(*keys, "x.path", "x.node")
        now = stored(now.withColumn("is_text", _kind(F.col("node")) == "STRING"), "trees")
        leaves.append(now.filter("is_text").select(*keys, "path", F.variant_get("node", "$", "string").alias("text")).filter("text <> ''"))
        now = now.filter("NOT is_text").drop("is_text")
        if now.isEmpty():
            break
    every = reduce(DataFrame.unionByName, leaves)
    out = every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("found"))
    return out.select(*keys, F.array_join(F.transform("found", lambda x: x["text"]), " ").alias("text"))


def _opened(path: Column, node: Column) -> Column:
    """One level of a node: array of (path, node); a string stays, what has no text leaves nothing."""
    def placed(p: Column, n: Column) -> Column:
        return F.struct(p.alias("path"), n.alias("node"))

    kind = _kind(node)
    parts = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v, i: placed(F.concat(path, F.array(i)), v))
    child = F.coalesce(*(_filled(F.try_variant_get(node, f"$.{name}", "variant")) for name in CHILDREN))
    inner = F.filter(F.array(placed(path, child)), lambda x: x["node"].isNotNull())
    return F.when(kind == "STRING", F.array(placed(path, node))).when(kind.startswith("ARRAY"), parts).when(kind.startswith("OBJECT"), inner)


def _filled(node: Column) -> Column:
    return F.when(~F.is_variant_null(node), node)


def nested_blocks(rows: DataFrame, key: str, body: str, sizes: DataFrame | None = None, prefix: str = "mu_") -> DataFrame:
    """(key, page, n, part, block, label, content, left, top, right, bottom, parent, source, caption_kind) from pages of nested blocks.

    body: JSON, a list of pages, each a list of blocks with a string type and an object content; input of another form gives no rows. A
    block is a row (part 0); a visual's footnote and caption are rows of their own with its id as parent, and no box (parts 1 and 2), as
    are captions that other blocks carry under any name ending in _caption. sizes: key, page, width and height in points; pages
    without have no boxes. Null bodies give no rows, and repeated rows of a key repeat its blocks' text: keys must be distinct."""
    def told(block: Column) -> Column:
        kind, content = F.try_variant_get(block, "$.type", "variant"), F.try_variant_get(block, "$.content", "variant")
        return (F.coalesce(_kind(kind), F.lit("")) == "STRING") & F.coalesce(_kind(content), F.lit("")).startswith("OBJECT")

    def good_page(page: Column) -> Column:
        return F.when(_kind(page).startswith("ARRAY"), F.forall(F.try_variant_get(page, "$", "array<variant>"), told)).otherwise(False)

    # Bodies are judged as a whole while they are one row, so blocks need not meet the bad ones' keys again.
    tree = rows.select(F.col(key).alias("k"), F.try_variant_get(F.try_parse_json(F.col(body)), "$", "array<variant>").alias("v"))
    pages = tree.filter(F.forall("v", good_page)).select("k", F.posexplode("v").alias("page", "v"))
    blocks = pages.select("k", "page", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("n", "v"))
    blocks = stored(blocks.withColumn("type", F.try_variant_get("v", "$.type", "string")), "blocks")
    visual = F.col("type").isin(*VISUALS)
    members = F.map_entries(F.try_variant_get("v", "$.content", "map<string, variant>"))
    own = F.when(F.col("type") == "list", "list_items").otherwise(F.concat("type", F.lit("_content")))

    def part(m: Column) -> Column:
        return (F.when((m["key"] == F.col("own")) & (F.col("type") != "table"), 0).when(F.col("visual") & (m["key"] == F.concat("type", F.lit("_footnote"))), 1)
                .when(F.col("visual") & (m["key"] == F.concat("type", F.lit("_caption"))), 2).when(~F.col("visual") & m["key"].endswith("_caption"), 2))

    named = blocks.select("k", "page", "n", "type", visual.alias("visual"), own.alias("own"), members.alias("m"))
    parts = named.select("k", "page", "n", F.explode(F.filter(F.transform("m", lambda m: F.struct(part(m).alias("part"), m["key"].alias("field"), m["value"].alias("node"))), lambda x: x["part"].isNotNull())).alias("x"))
    texts = joined_text(parts.select("k", "page", "n", "x.part", "x.field", "x.node"), ["k", "page", "n", "part", "field"])
    path = F.concat(F.lit(prefix), F.lit("p"), F.col("page"), F.lit("_v"), F.col("n"))
    html = F.try_variant_get("v", "$.content.html", "string")
    label = (F.when(visual, F.col("type")).when(F.col("type") == "title", F.when((F.col("page") == 0) & (F.try_variant_get("v", "$.content.level", "int") == 1), "doc_title").otherwise("paragraph_title"))
             .when(F.col("type").isin(*RUNNING), "text").otherwise(F.col("type")))
    # Only what a row needs of a block meets its text, not the block.
    shown = blocks.select("k", "page", "n", "type", label.alias("label"), path.alias("block"), html.alias("html"), F.try_variant_get("v", "$.bbox", "array<double>").alias("box"), F.when(visual, path).alias("parent"),
                          F.try_variant_get("v", "$.content.image_source.path", "string").alias("source"))
    main = shown.join(texts.filter("part = 0").drop("part", "field"), ["k", "page", "n"], "left").select(
        "k", "page", "n", F.lit(0).alias("part"), "block", "label", F.when(F.col("type") == "table", F.coalesce("html", F.lit(""))).otherwise(F.coalesce("text", F.lit(""))).alias("content"),
        "box", "parent", "source", F.lit(None).cast("string").alias("caption_kind"))
    of = blocks.select("k", "page", "n", "type", visual.alias("visual"), path.alias("parent"))
    extra = texts.filter("part > 0").join(of, ["k", "page", "n"]).filter((F.col("part") == 1) | ~T.is_blank(F.col("text")))
    ending = F.when(F.col("part") == 1, "note").when(F.col("visual"), "cap").otherwise(F.col("field"))
    extra = extra.select("k", "page", "n", "part", F.concat_ws("_", "parent", ending).alias("block"), F.when(F.col("part") == 1, "vision_footnote").when(F.col("visual"), "figure_title").otherwise(F.col("field")).alias("label"),
                         F.col("text").alias("content"), F.lit(None).cast("array<double>").alias("box"), "parent", F.lit(None).cast("string").alias("source"),
                         F.when((F.col("part") == 2) & F.col("visual"), F.when(F.col("type") == "image", "figure").otherwise(F.col("type"))).alias("caption_kind"))
    out = main.unionByName(extra)
    if sizes is None:
        out = out.withColumns({"width": F.lit(None).cast("double"), "height": F.lit(None).cast("double")})
    else:
        out = out.join(sizes.select(F.col(key).alias("k"), "page", "width", "height"), ["k", "page"], "left")
    b = F.col("box")
    good = (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (b[2] > b[0]) & (b[3] > b[1])
    edges = [F.when(good, F.get(b, F.lit(i)) * F.col("width" if i % 2 == 0 else "height") / SCALE).alias(name) for i, name in enumerate(("left", "top", "right", "bottom"))]
    return out.select(F.col("k").alias(key), "page", "n", "part", "block", "label", "content", *edges, "parent", "source", "caption_kind")


# Metadata inside PDF files ------------------------------------------------------------------------------------------------

# The fields that are read, and what a letter behind a backslash stands for.
INFO_FIELDS = ("Title", "Author", "Subject", "Keywords")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
NO_AUTHORS = ("cnki", "中国知网", "china academic journal")
#: The parts of a literal string: an escape, a bracket, or a stretch of anything else.
_LITERAL = re.compile(rb"\\(\r\n|[0-7]{1,3}|.)|([()])|([^\\()]+)", re.DOTALL)


def _literal(data: bytes, at: int) -> bytes:
    """The value of a literal string whose opening bracket is at a place; of one that never closes, all that follows."""
    out, depth = [], 0
    for token in _LITERAL.finditer(data, at):
        escape, bracket, plain = token.groups()
        depth += {b"(": 1, b")": -1}.get(bracket, 0)
        if not depth:
            break
        if escape is None:
            out.append(plain or bracket)
        elif escape[:1].isdigit() and escape[:1] < b"8":
            out.append(bytes([int(escape, 8) & 255]))
        elif escape not in (b"\r\n", b"\r", b"\n"):  # a line's end behind a backslash joins the lines
            out.append(ESCAPES.get(escape, escape))
    return b"".join(out)[1:]


def _decoded(raw: bytes) -> str:
    """UTF-16 by its mark, else UTF-8, else one byte a character."""
    marks = {b"\xfe\xff": "utf-16-be", b"\xff\xfe": "utf-16-le"}
    if raw[:2] in marks:
        return raw[2 : len(raw) // 2 * 2].decode(marks[raw[:2]], "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def info_field(data: bytes, name: str) -> str | None:
    """The first value of /name that is a string, white space collapsed; null if there is none or it is blank."""
    for found in re.finditer(rb"/" + name.encode() + rb"[\x00\t\n\f\r ]*(\(|<(?!<))", data):
        if found.group(1) == b"(":
            raw = _literal(data, found.start(1))
        else:
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[found.end() : data.find(b">", found.end()) if b">" in data[found.end() :] else len(data)])
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return re.sub(r"\s+", " ", _decoded(raw)).strip() or None
    return None


def pdf_info(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, title, authors, subject, keywords, year, doi) from the Info dictionary in PDF files' bytes. A title that is a path or a
    placeholder is null; authors are split at semicolons and "and", without names of databases; year and DOI come from the title, the
    subject and the keywords. Null or other bytes have null fields and no authors."""
    kind = dict(files.dtypes)[key]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = {name: [None if c is None else info_field(bytes(c), name) for c in part["c"]] for name in INFO_FIELDS}
            yield pd.DataFrame({"k": part["k"], **values})

    raw = files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(read, f"k {kind}, " + ", ".join(f"{n} string" for n in INFO_FIELDS))
    title = F.when(T.is_plausible_title(F.col("Title")), F.col("Title"))
    names = F.filter(F.transform(F.split("Author", r"(?i)\s*(?:;|\band\b)\s*"), T.strip), lambda a: (a != "") & ~F.exists(F.array(*(F.lit(n) for n in NO_AUTHORS)), lambda n: F.contains(F.lower(a), n)))
    about = F.concat_ws(" ", title, "Subject", "Keywords")
    return raw.select(F.col("k").alias(key), title.alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.col("Subject").alias("subject"), F.col("Keywords").alias("keywords"),
                      T.first_year(about).alias("year"), T.first_doi(about).alias("doi"))
