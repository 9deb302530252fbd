"""Markdown documents as rows: lines, headings, sections, paragraphs, references, tables, protected spans.

Structure is found with regular expressions over whole texts and kept as places (start, end) in code points; sections and
neighbours are windows over those rows. Only reflowing and HTML tables, which walk a text with a state, are Python helpers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions import text as T
from paperloom.functions.places import let, overlaps, pieces, placed, running

#: Default heading patterns: (section, level, pattern). Level 1 counts anywhere, 2 from half of the text, 3 from 60 %.
#: Larger multilingual tables are passed as a parameter of the same form.
BACK_MATTER = (
    ("references", 1, r"references?|bibliograph(?:y|ies)|works?\s+cited|literature\s+cited|参考文献|références|literaturverzeichnis|referencias"),
    ("acknowledgements", 1, r"acknowledg(?:e|le)?ments?|致谢|remerciements?|danksagung(?:en)?|agradecimientos?"),
    ("declarations", 2, r"author\s+contributions?|competing\s+interests?|conflicts?\s+of\s+interests?|declarations?"),
    ("funding", 2, r"funding(?:\s+(?:sources?|statement|information))?|financial\s+support|grant\s+support"),
    ("availability", 2, r"data\s+(?:and\s+(?:code|materials?)\s+)?availability"),
    ("ethics", 3, r"ethics?\s+(?:statement|declaration|approval|review)|informed\s+consent"),
)
LEVEL_START = {1: 0.0, 2: 0.5, 3: 0.6}
BLANK_LINE = r"\n[ \t]*\n"
# The spans that translation must not touch. A formula in brackets ends at its first closing mark that no backslash
# escapes; one between dollar signs touches neither with a blank, and a digit behind the second makes it a price.
INLINE_CODE = r"`[^`\n]++`"
ROUND_FORMULA = r"\\\((?:\\[^)]|[^\\])++\\\)"
SQUARE_FORMULA = r"\\\[(?:\\[^\]]|[^\\])++\\\]"
DOLLAR_FORMULA = r"\$(?=\S)[^$\n]*+(?<!\s)\$(?![0-9])"
PROTECTED = f"{INLINE_CODE}|{ROUND_FORMULA}|{SQUARE_FORMULA}|{DOLLAR_FORMULA}"
# Fenced code, display formulas, and the blank characters that Markdown trims.
FENCED_CODE = r"(?m)^[ \t]*(?:```[^\n]*\n[\s\S]*?\n[ \t]*```|~~~[^\n]*\n[\s\S]*?\n[ \t]*~~~)[ \t]*$"
DISPLAY_FORMULA = r"\$\$[\s\S]*?\$\$"
LEADING_BLANKS, TRAILING_BLANKS = r"^[ \t\r\n]+", r"[ \t\r\n]+$"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, start, end, line): every line with its place."""
    return docs.select(F.col(key), F.posexplode(pieces(F.col(text), "\n")).alias("n", "p")).select(key, "n", "p.start", "p.end", F.col("p.value").alias("line"))


def _shifted(states: Column, first: Column) -> Column:
    """The states before each element, from those after each."""
    return F.slice(F.concat(F.array(first), states), F.lit(1), F.size(states))


def outline(text: Column) -> Column:
    """Every heading in order: array of (n, start, end, line, level, title, next, content_start, content_end). next: where the next heading
    of level 3 or less starts, null if there is none; content_start and content_end: the first and behind the last character up to
    there that is not blank (content_end is null where next is: the text's own last one then)."""
    row = "struct<n: int, start: int, end: int, line: string, filled_from: int, filled_to: int, heading: boolean, major: boolean>"

    def line(p: Column, n: Column) -> Column:
        v = p["value"]
        filled = v.rlike(r"[^ \t\r]")
        return F.struct(n.alias("n"), p["start"].alias("start"), p["end"].alias("end"), v.alias("line"), F.when(filled, p["end"] - F.length(F.regexp_replace(v, LEADING_BLANKS, ""))).alias("filled_from"),
                        F.when(filled, p["start"] + F.length(F.regexp_replace(v, TRAILING_BLANKS, ""))).alias("filled_to"), v.rlike(r"^\s*#{1,6}\s*\S").alias("heading"), v.rlike(r"^#{1,3}\s+\S").alias("major")).cast(row)

    ahead = "struct<filled: int, major: struct<start: int, filled: int>>"

    def seen(rows: Column) -> Column:
        filled = running(F.transform(rows, lambda r: r["filled_to"]), lambda a, b: F.coalesce(b, a))
        pairs = F.zip_with(rows, _shifted(filled, F.lit(None).cast("int")), lambda r, before: F.struct(r.alias("r"), before.alias("before")))
        return let(F.reverse(pairs), backwards)

    def backwards(pairs: Column) -> Column:
        own = F.transform(pairs, lambda p: F.struct(p["r"]["filled_from"].alias("filled"), F.when(p["r"]["major"], F.struct(p["r"]["start"].alias("start"), p["before"].alias("filled"))).alias("major")).cast(ahead))
        states = running(own, lambda a, b: F.struct(F.coalesce(b["filled"], a["filled"]).alias("filled"), F.coalesce(b["major"], a["major"]).alias("major")))
        return F.reverse(F.zip_with(pairs, _shifted(states, F.lit(None).cast(ahead)), lambda p, s: F.struct(p["r"].alias("r"), s.alias("s"))))

    def heading(x: Column) -> Column:
        r = x["r"]
        title = T.strip(F.regexp_replace(r["line"], r"^\s*#{1,6}\s*(?:\d+(?:\.\d+)*[.)]?\s+)?", ""))
        return F.struct(r["n"].alias("n"), r["start"].alias("start"), r["end"].alias("end"), r["line"].alias("line"), F.length(F.regexp_extract(r["line"], r"^\s*(#{1,6})", 1)).alias("level"), title.alias("title"),
                        x["s"]["major"]["start"].alias("next"), x["s"]["filled"].alias("content_start"), x["s"]["major"]["filled"].alias("content_end"))

    found = F.transform(F.filter(let(F.transform(pieces(text, "\n"), line), seen), lambda x: x["r"]["heading"]), heading)
    return F.when(F.contains(text, F.lit("#")), found)  # most texts have none


def _headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`headings`, with where each section's content starts and ends."""
    # Lengths go into the rows that are exploded: beside them they would be counted for every row, and the text carried along.
    whole = F.struct(F.length(text).alias("size"), F.length(F.regexp_replace(F.col(text), TRAILING_BLANKS, "")).alias("filled"))
    found = let(whole, lambda w: F.transform(outline(F.col(text)), lambda h: F.struct(h.alias("h"), w.alias("w"))))
    rows = docs.select(F.col(key), F.explode(found).alias("x"))
    return rows.select(key, "x.h.*", "x.w.size", F.coalesce("x.h.next", "x.w.size").alias("section_end"), "x.w.filled").withColumn(
        "content_start", F.coalesce("content_start", "size")).withColumn("content_end", F.when(F.col("next").isNull(), F.col("filled")).otherwise(F.col("content_end")))


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Headings with level, title, and where their section ends: at the next heading of level 3 or less, or the end."""
    return _headings(docs, key, text).select(key, "n", "start", "end", "line", "level", "title", "size", "section_end")


def back_matter(docs: DataFrame, key: str, text: str, patterns: tuple[tuple[str, int, str], ...] = BACK_MATTER) -> DataFrame:
    """(key, section, level, heading_start, content_start, content_end) of detected sections; those without content are left out."""
    h = _headings(docs, key, text)
    cases = []
    for section, level, pattern in patterns:
        fits = F.lower("title").rlike(rf"(?U)^(?:{pattern})\s*(?:[:：\-–—].*)?$") & (F.col("start") >= F.floor(F.col("size") * LEVEL_START[level]))
        cases.append(F.when(fits, F.struct(F.lit(section).alias("section"), F.lit(level).alias("level"))))
    hit = h.withColumn("hit", F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull()))).filter("content_start < content_end")
    return hit.select(key, "hit.section", F.col("hit.level").alias("level"), F.col("start").alias("heading_start"), "content_start", "content_end")


def compact(docs: DataFrame, key: str, text: str, most: int = 24_000, tail_from: int = 8_000) -> DataFrame:
    """The text up to its back matter (else, if long, up to the first heading in its last fifth), without images, cut to most."""
    first = back_matter(docs, key, text).groupBy(key).agg(F.min("heading_start").alias("_first"))
    late = headings(docs, key, text).filter((F.col("size") > tail_from) & (F.col("start") >= 0.8 * F.col("size"))).groupBy(key).agg(F.min("start").alias("_late"))
    joined = docs.join(first, key, "left").join(late, key, "left")
    cut = F.substr(F.col(text), F.lit(1), F.coalesce("_first", "_late", F.length(text)))
    return joined.select(key, F.left(F.regexp_replace(cut, r"!\[[^\]]*\]\([^)]*\)", ""), F.lit(most)).alias("text"))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, text, kind, hash) of paragraphs between blank lines; code, $$ blocks, lone images and tables are not."""
    filled = F.filter(pieces(F.col(text), BLANK_LINE), lambda p: p["end"] > p["start"])
    skipped = [placed(F.col(text), FENCED_CODE), placed(F.col(text), DISPLAY_FORMULA)]

    def free(parts: Column) -> Column:
        hit = F.zip_with(parts, overlaps(parts, skipped), lambda p, o: F.when(o.isNull(), p))
        return F.filter(hit, lambda p: p.isNotNull())

    kept = F.when(F.col(text).rlike(r"```|~~~|\$\$"), let(filled, free)).otherwise(filled)
    rows = docs.select(F.col(key), F.explode(kept).alias("p"))
    trimmed = F.regexp_replace("p.value", rf"{LEADING_BLANKS}|{TRAILING_BLANKS}", "")
    start = F.col("p.start") + F.length("p.value") - F.length(F.regexp_replace("p.value", LEADING_BLANKS, ""))
    rows = rows.select(key, start.alias("start"), (start + F.length(trimmed)).alias("end"), trimmed.alias("text"))
    # What is an image or a table, and how the kinds begin.
    rows = rows.filter((F.col("text") != "") & ~F.col("text").rlike(r"^!\[[^\]]*\]\([^)]*\)[ \t]*$") & ~F.col("text").rlike(r"(?m)^\s*\|[- :|]+\|\s*$"))
    kind = F.when(F.col("text").rlike(r"^#{1,6}\s"), "heading").when(F.col("text").rlike(r"^>\s"), "blockquote").when(F.col("text").rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list").otherwise("text")
    return rows.withColumn("kind", kind).withColumn("hash", T.paragraph_hash(F.col("text")))


def outside(ranges: DataFrame, ignored: DataFrame, key: str) -> DataFrame:
    """Rows (key, start, end) that overlap no ignored range (key, start, end) of the same document."""
    other = ignored.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return ranges.join(other, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left_anti")


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, text, numbered): the reference list; numbered items, or else paragraphs of 20 characters that look like one."""
    h = headings(docs, key, text).filter(F.col("line").rlike(r"(?i)^#{1,3}\s+(?:References|参考文献|Bibliography|Works?\s+Cited)"))
    first = h.groupBy(key).agg(F.min(F.struct("start", "end", "section_end")).alias("h"))
    body = docs.select(key, text).join(first, key).select(key, F.substr(F.col(text), F.col("h.end") + 1, F.col("h.section_end") - F.col("h.end")).alias("s"))
    mark = r"(?m)^\s*(?:\[(\d+)\]|(\d+)[.)])\s+"
    marks, parts = F.regexp_extract_all("s", F.lit(mark), F.lit(0)), F.split("s", mark, -1)
    items = F.zip_with(marks, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    body = body.withColumn("marked", F.col("s").rlike(mark))
    numbered = body.filter("marked").select(key, F.explode(items).alias("i")).select(
        key, F.regexp_extract("i.m", r"\d+", 0).cast("int").alias("number"), T.collapse(F.col("i.p")).alias("text"), F.lit(True).alias("numbered"))
    plain = body.filter("NOT marked").select(key, F.posexplode(F.filter(F.transform(F.split("s", BLANK_LINE), T.collapse), lambda p: (F.length(p) >= 20) & T.looks_like_reference(p))).alias("n", "text"))
    return numbered.filter("text <> ''").unionByName(plain.select(key, (F.col("n") + 1).cast("int").alias("number"), "text", F.lit(False).alias("numbered")))


def masked(text: Column) -> Column:
    """struct(masked, spans): inline code and formulas replaced by [[m0]], [[m1]], ..."""
    spans, between = F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0)), F.split(text, PROTECTED, -1)
    # A mark stands before every part but the first; no other expression is in the function, which runs once a part.
    parts = F.transform(between, lambda p, i: F.when(i > 0, F.concat(F.lit("[[m"), (i - 1).cast("string"), F.lit("]]"), p)).otherwise(p))
    return F.struct(F.array_join(parts, "").alias("masked"), spans.alias("spans"))


def unmasked(text: Column, spans: Column) -> Column:
    """Placeholders replaced by their spans, blanks inside tolerated; numbers without a span stay."""
    mark = r"\[\[\s*m(\d+)\s*\]\]"
    marks, between = F.regexp_extract_all(text, F.lit(mark), F.lit(0)), F.split(text, mark, -1)

    def back(part: Column, m: Column) -> Column:
        return F.concat(part, F.coalesce(F.get(spans, F.regexp_extract(m, r"\d+", 0).try_cast("int")), m, F.lit("")))

    return F.array_join(F.zip_with(between, marks, back), "")


def before_title_dropped(md: Column, title: Column) -> Column:
    """The text from the first heading that is the title: equal, contained, or sharing 80 % of its longer words."""
    t = T.comparison_key(title)
    words = F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) > 2))
    parts = F.split(md, "\n")

    def fits(line: Column) -> Column:
        h = T.comparison_key(F.regexp_replace(line, r"^\s*#+\s*", ""))
        share = F.size(F.array_intersect(words, F.split(h, " "))) / F.greatest(F.size(words), F.lit(1))
        return F.startswith(F.ltrim(line), F.lit("#")) & (F.contains(h, t) | F.contains(t, h) | ((F.size(words) > 0) & (share >= 0.8)))

    at = F.array_position(F.transform(parts, fits), True)
    return F.when((t != "") & (at > 1), F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "\n")).otherwise(md)


def equations_promoted(md: Column, most: int = 60) -> Column:
    """Formulas alone on a line become display formulas if they hold an equals sign or are longer than most."""
    lone = r"^[ \t]*\$([^$\n]+)\$[ \t]*$"

    def line(s: Column) -> Column:
        inner = T.strip(F.regexp_extract(s, lone, 1))
        shown = s.rlike(lone) & (F.contains(inner, F.lit("=")) | (F.length(inner) > most))
        return F.when(shown, F.concat(F.lit("\n$$\n"), inner, F.lit("\n$$\n"))).otherwise(s)

    return F.array_join(F.transform(F.split(md, "\n", -1), line), "\n")


def formulas_spaced(md: Column) -> Column:
    """Blanks next to the dollar signs of inline formulas dropped; display formulas on lines of their own."""
    md = F.regexp_replace(md, r"(?<!\$)\$(?!\$)[ \t]*([^$\n]*[^$\s])[ \t]*(?<!\$)\$(?!\$)", r"\$$1\$")
    return F.regexp_replace(md, r"(?s)\s*\$\$\s*(.+?)\s*\$\$[ \t]*\n?", "\n\\$\\$\n$1\n\\$\\$\n")


def centred_divs_unwrapped(md: Column) -> Column:
    """Centred one-line divs: their text in italics, but images and sub-labels as they are."""
    div = r"<div\b[^>]*\btext-align[ \t]*:[ \t]*center\b[^>]*>([^\n]*?)</div>"
    found, between = F.transform(F.regexp_extract_all(md, F.lit(div), F.lit(1)), T.strip), F.split(md, div, -1)

    def unwrapped(c: Column) -> Column:
        bare = F.contains(c, F.lit("<img")) | F.lower(c).rlike(T.SUB_LABEL)
        return F.when(bare, c).otherwise(F.concat(F.lit("*"), c, F.lit("*")))

    return F.array_join(F.zip_with(between, found, lambda b, c: F.concat(b, F.coalesce(unwrapped(c), F.lit("")))), "")


def html_title(html: Column) -> Column:
    return T.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column, most: int = 10_000) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, common entities decoded, white space collapsed, cut to most."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return F.left(T.collapse(t), F.lit(most))


def pipe_table(md: Column) -> Column:
    """Cells of a pipe table as array of rows, the header first; null if it is none or its rows differ in width."""
    def cells(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(T.strip(line), r"^\|", ""), r"(?<!\\)\|$", "")
        return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.replace(T.strip(c), F.lit("\\|"), F.lit("|")))

    rows = F.split(T.strip(md), r"\r?\n")
    split = F.transform(rows, cells)
    rule = F.get(split, F.lit(1))
    body = F.concat(F.slice(split, 1, 1), F.slice(split, F.lit(3), F.greatest(F.size(split) - 2, F.lit(0))))
    fits = (F.size(rows) >= 2) & F.contains(F.get(rows, F.lit(0)), F.lit("|")) & F.forall(rule, lambda c: c.rlike("^:?-{3,}:?$")) & F.forall(body, lambda r: F.size(r) == F.size(rule))
    return F.when(fits & (F.size(body) * F.size(rule) <= 100_000), body)


def table_tsv(rows: Column) -> Column:
    quoted = F.transform(rows, lambda r: F.transform(r, lambda c: F.when(c.rlike("[\t\r\n\"]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)))
    return F.array_join(F.transform(quoted, lambda r: F.array_join(r, "\t")), "\n")


def table_markdown(rows: Column) -> Column:
    def line(r: Column) -> Column:
        safe = F.transform(r, lambda c: F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>"))
        return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))

    rule = line(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")))
    out = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(out, 1, 1), F.array(rule), F.slice(out, F.lit(2), F.size(out))), "\n")


def table_html(rows: Column) -> Column:
    """A table as HTML, the first row as headers; marks of HTML in cells are escaped, line ends become <br>."""
    def safe(c: Column) -> Column:
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(mark), F.lit(name))
        return F.regexp_replace(c, r"\r?\n", "<br>")

    def line(r: Column, i: Column) -> Column:
        head = F.array_join(F.transform(r, lambda c: F.concat(F.lit("<th>"), safe(c), F.lit("</th>"))), "")
        body = F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), safe(c), F.lit("</td>"))), "")
        return F.concat(F.lit("<tr>"), F.when(i == 0, head).otherwise(body), F.lit("</tr>"))

    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))


class _Tables(HTMLParser):
    """Rows of outermost tables as lists of (text, rowspan, colspan, header)."""

    def __init__(self):
        super().__init__()
        self.tables, self.depth, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            a = dict(attrs)
            self.cell = ["", a.get("rowspan", "1"), a.get("colspan", "1"), tag == "th"]
            self.tables[-1][-1].append(self.cell)
        elif tag == "br" and self.cell:
            self.cell[0] += "\n"

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        if tag in ("td", "th", "tr", "table") and self.depth <= 1:
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[0] += data


def _table_cells(html: str) -> Iterator[tuple]:
    """(table, row, column, rowspan, colspan, text, header, problem); a table with a problem is one row without cells."""
    parser = _Tables()
    parser.feed(html or "")
    for t, rows in enumerate(parser.tables):
        taken, out, problem = set(), [], None if 0 < len(rows) <= 10_000 else "table_size"
        for r, cells in enumerate(rows if not problem else []):
            c = 0
            for text, down, right, header in cells:
                while (r, c) in taken:
                    c += 1
                down = len(rows) - r if down == "0" else int(down) if down.isdigit() else -1
                right = int(right) if right.isdigit() else -1
                if not (1 <= down <= 1000 and 1 <= right <= 1000):
                    problem = problem or "table_span"
                elif r + down > len(rows) or c + right > 1000 or (r + down) * (c + right) > 100_000:
                    problem = problem or "table_size"
                else:
                    area = {(y, x) for y in range(r, r + down) for x in range(c, c + right)}
                    problem = problem or ("table_overlap" if area & taken else None)
                    taken |= area
                    out.append((t, r, c, down, right, text.strip(), header, None))
                    c += right
        problem = problem or (None if out else "table_size")
        yield from [(t, None, None, None, None, None, None, problem)] if problem else out


def html_tables(docs: DataFrame, key: str, html: str) -> DataFrame:
    """One row a cell of every outermost table."""
    names = ["table", "row", "column", "row_span", "column_span", "text", "header", "problem"]

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(k, *cell) for k, h in zip(part["k"], part["h"], strict=True) for cell in _table_cells(h)]
            yield pd.DataFrame(found, columns=["k", *names]).astype({n: "Int32" for n in names[:5]})

    kind = dict(docs.dtypes)[key]
    rows = docs.filter(F.lower(html).contains("<table")).select(F.col(key).alias("k"), F.col(html).alias("h"))
    return rows.mapInPandas(cells, f"k {kind}, table int, row int, `column` int, row_span int, column_span int, text string, header boolean, problem string").withColumnRenamed("k", key)


_CJK = r"[一-鿿㐀-䶿　-〿＀-￯]"
_OWN_LINE = re.compile(r"#|[-*+]\s|\d+[.)]\s|\||!\[|>|<|(?:-{3,}|\*{3,}|_{3,})$|\([a-zA-Z]\)$")


def _joined(a: str, b: str) -> str:
    a, b = a.rstrip(), b.lstrip()
    if a.endswith("-") and b[:1].isascii() and b[:1].islower():
        return a[:-1] + b
    return a + b if re.search(_CJK + "$", a) or re.match(_CJK, b) else f"{a} {b}"


def reflow(text: str) -> str:
    """Soft line breaks joined; paragraphs that a page break cut in two joined as well; structure and fences as they are."""
    out: list[str] = []
    pending, fence = "", None

    def flush() -> None:
        nonlocal pending
        if not pending:
            return
        last = next((i for i in range(len(out) - 1, -1, -1) if out[i].strip()), None)
        before = out[last].rstrip() if last is not None else ""
        ended = re.search(r"[.!?。！？:;⁰-₟¹²³]$", before)
        if before and not _OWN_LINE.match(before.strip()) and before.strip() not in ("$$",) and not before.strip().startswith("```") and not ended:
            out[last:] = [_joined(before, pending)]
        else:
            out.append(pending)
        pending = ""

    for line in text.split("\n"):
        bare = line.strip()
        mark = "```" if bare.startswith("```") else "$$" if bare == "$$" else None
        if fence or mark:
            flush()
            out.append(line)
            fence = (None if fence == mark else fence or mark) if mark else fence
        elif not bare:
            flush()
            out.append("")
        elif _OWN_LINE.match(bare):
            flush()
            out.append(line)
        else:
            pending = _joined(pending, line) if pending else line
    flush()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out))


@F.pandas_udf(StringType())
def reflowed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else reflow(t))
