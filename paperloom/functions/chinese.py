"""Chinese journals' first pages, and emphasis next to Chinese punctuation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.places import let

# How a year, the author line's end, a name, a journal and a header's other parts are written; words that are no names.
YEAR = r"((?:19|20)\d{2})\s*年"
ARTICLE_YEAR = r"文章编号[：:][\d-]+[（(]((?:19|20)\d{2})[）)]"
ANY_YEAR = r"(?:19|20)\d{2}"
AUTHORS_END = r"(?i)[（(]\s*1\s*[.．、]|摘\s*要|关\s*键\s*词|Abstract|Key\s*words"
BETWEEN_NAMES = r"[,，、;；]"
NAME = r"[一-鿿]{2,4}"
NAMES_IN_A_ROW = r"(?:[一-鿿]{2,4}[,，、;；\d\s*]*){2,}[一-鿿]{2,4}"
JOURNAL = r"[一-鿿]{2,12}(?:学报|学刊|杂志|通报|导报|公报|评论|论坛|科学|医学|科技|工程|译丛|文摘|研究|进展|报告|纪要|年鉴|快报|通讯|集刊|丛刊|学术|综述)"
HEADER_NOISE = (r"第\s*\d+\s*[卷期]", r"(?:19|20)\d{2}\s*年(?:\s*\d{1,2}\s*月)?", r"[A-Za-z0-9．.:：/\-]+")
NO_NAMES = ("文章编号", "基金项目", "中图分类", "文献标识", "收稿日期", "修回日期", "通讯作者", "第一作者", "作者简介", "引用格式", "网络出版", "网络首发", "参考文献", "摘要", "关键词")
#: Characters behind a title that authors are looked for in where nothing ends their line, and those at the front of a page without a title.
BEHIND_TITLE, FRONT = 60, 300
# Punctuation that emphasis may touch, and what its marks mean.
PUNCTUATION = "[　-〿！-･“”‘’]"
MARKED = r"(\*\*\*|___|\*\*|__|~~|\*)(?!\s)([^\n]+?)(?<!\s)\1"
EMPHASIS = (("***", "<strong><em>", "</em></strong>"), ("___", "<strong><em>", "</em></strong>"), ("**", "<strong>", "</strong>"), ("__", "<strong>", "</strong>"), ("~~", "<del>", "</del>"), ("*", "<em>", "</em>"))


def compact(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def is_no_name(name: Column) -> Column:
    """One of the words of a first page that look like names."""
    return T.strip(name).isin(*NO_NAMES)


def names(segment: Column) -> Column:
    """The names in a list: of each part the only Chinese word, if it has two to four characters and nothing Chinese is beside it."""
    def one(part: Column) -> Column:
        name = _first(part, NAME)
        alone = ~F.regexp_replace(part, rf"^([^一-鿿]*){NAME}", "$1").rlike("[一-鿿]")
        return F.when(name.isNotNull() & ~is_no_name(name) & alone, name)

    return F.filter(F.transform(F.split(segment, BETWEEN_NAMES), one), lambda n: n.isNotNull())


def first_page(text: Column, title: Column, title_start: Column | None = None) -> Column:
    """struct(authors, journal, year, doi) of a first page; all null (no authors) for a blank one.

    The title (or null) tells the header from the authors. title_start: where it begins in the text without white space, if it was found
    by other means; by default where it occurs. Year: one before 年, else that of the article's number, else one in the DOI.
    """
    flat, needle = compact(text), compact(title)
    start = F.coalesce(F.when(needle != "", F.instr(flat, needle) - 1), F.lit(-1))
    start = start if title_start is None else F.when(start >= 0, start).otherwise(F.coalesce(title_start, F.lit(-1)))
    bound = F.struct(flat.alias("flat"), start.alias("start"), F.when(start >= 0, start + F.length(needle)).otherwise(-1).alias("end"))

    def found(page: Column) -> Column:
        region = F.substr(page["flat"], F.greatest(page["end"], F.lit(0)) + 1)
        line = F.when(region.rlike(AUTHORS_END), F.get(F.split(region, AUTHORS_END, 2), F.lit(0))).otherwise(F.left(region, F.lit(BEHIND_TITLE)))
        anchored = names(line)
        row = names(F.regexp_extract(F.left(page["flat"], F.lit(FRONT)), NAMES_IN_A_ROW, 0))
        authors = F.when((F.size(anchored) == 0) & (page["end"] < 0) & (F.size(row) >= 2), row).otherwise(anchored)
        header = F.left(page["flat"], page["start"])
        for noise in HEADER_NOISE:
            header = F.regexp_replace(header, noise, "")
        doi = F.lower(T.normalize_doi(_first(text, r"(?i)10\.\d{4,}/[^\s\"{}|\\^`\[\]]+")))
        year = F.coalesce(_first(text, YEAR, 1), _first(page["flat"], ARTICLE_YEAR, 1), _first(doi, ANY_YEAR))
        return F.struct(authors.alias("authors"), F.when(page["start"] > 0, _first(header, JOURNAL)).alias("journal"), year.alias("year"), doi.alias("doi"))

    none = F.struct(F.array().cast("array<string>").alias("authors"), *(F.lit(None).cast("string").alias(n) for n in ("journal", "year", "doi")))
    return F.when(T.is_blank(text), none).otherwise(let(bound, found))


def emphasised(md: Column) -> Column:
    """Emphasis whose text begins or ends with Chinese punctuation as HTML, which other readers of Markdown leave as it is. Marks touch their
    text without a blank and stay within a line; longer marks come first. Other emphasis is passed over as a whole and left to the reader,
    and what lies within emphasis stays as it is."""
    found, between = F.regexp_extract_all(md, F.lit(MARKED), F.lit(0)), F.split(md, MARKED, -1)

    def shown(span: Column) -> Column:
        inner = F.regexp_extract(span, MARKED, 2)
        out = span
        for mark, opening, closing in reversed(EMPHASIS):
            out = F.when(F.regexp_extract(span, MARKED, 1) == mark, F.concat(F.lit(opening), inner, F.lit(closing))).otherwise(out)
        return F.when(F.substring(inner, 1, 1).rlike(PUNCTUATION) | F.right(inner, F.lit(1)).rlike(PUNCTUATION), out).otherwise(span)

    return F.array_join(F.zip_with(between, found, lambda b, s: F.concat(b, F.coalesce(shown(s), F.lit("")))), "")
