"""Readers of offline records: bibliographic JSON and XML, OCR pages in three shapes, chat sessions, folders and packages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.places import let

CROSSREF = ("struct<title:array<string>,`container-title`:array<string>,author:array<struct<given:string,family:string,name:string>>,DOI:string,"
            "`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>>")
BLOCK = ("struct<block_id:string,block_label:string,block_content:string,block_bbox:array<double>,group_id:int,global_group_id:int,block_order:int,parent_id:string>")
PAGE = f"struct<page_index:int,markdown:struct<text:string,images:map<string,string>>,prunedResult:struct<parsing_res_list:array<{BLOCK}>>>"
LAYOUT = "struct<pdf_info:array<struct<page_idx:int,page_size:array<double>,para_blocks:array<struct<type:string,bbox:array<double>,lines:array<struct<bbox:array<double>,spans:array<struct<type:string,content:string>>>>>>>>>"
ITEM = ("struct<key:string,version:bigint,data:struct<itemType:string,deleted:string,title:string,creators:array<struct<creatorType:string,firstName:string,lastName:string,name:string>>,publicationTitle:string,"
        "proceedingsTitle:string,bookTitle:string,publisher:string,repository:string,date:string,DOI:string,ISBN:string,tags:array<struct<tag:string>>,contentType:string,linkMode:string,parentItem:string,filename:string>>")
# Item types that are documents, and the link modes of attachments that are files.
DOCUMENT_TYPES = ("journalArticle", "conferencePaper", "preprint", "book", "bookSection", "thesis", "report", "manuscript", "encyclopediaArticle", "dictionaryEntry", "magazineArticle", "newspaperArticle")
FILE_MODES = ("imported_file", "imported_url", "linked_file")
#: Block types of the layout shape and the labels they get.
LABELS = (("image_body", "image"), ("table_body", "table"), ("image_caption", "figure_title"), ("table_caption", "figure_title"), ("title", "paragraph_title"))
SESSION = ("id string, title string, createdAt timestamp, updatedAt timestamp, messages array<struct<role:string,content:string,quotedText:string>>")


def crossref(body: Column) -> Column:
    """struct(title, authors, journal, year, doi) of a work record; year of the print, else online, else published date."""
    m = F.from_json(body, CROSSREF)
    year = F.coalesce(*(F.get(F.get(m[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "published")))
    authors = F.filter(F.transform(m["author"], lambda a: F.coalesce(F.nullif(T.person_name(a["given"], a["family"]), F.lit("")), T.trim_to_null(a["name"]))), lambda n: n.isNotNull())
    return F.struct(F.get(m["title"], F.lit(0)).alias("title"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), F.get(m["container-title"], F.lit(0)).alias("journal"),
                    year.cast("string").alias("year"), T.normalize_doi(m["DOI"]).alias("doi"))


def pubmed(body: Column) -> Column:
    """struct(title, authors, journal, year, doi, keywords) of one article's XML; keywords distinct whatever their case."""
    def all_of(path: str) -> Column:
        return F.xpath(body, F.lit(path + "/text()"))

    def text(path: str) -> Column:
        return let(F.xpath_string(body, F.lit(path)), lambda v: F.when(v != "", v))

    family = all_of("//Author/LastName")
    authors = let(all_of("//Author/ForeName"), lambda given: F.transform(family, lambda f, i: T.person_name(F.get(given, i), f)))
    year = F.coalesce(text("//PubDate/Year"), text("//ArticleDate/Year"), T.first_year(F.xpath_string(body, F.lit("//PubDate/MedlineDate"))))
    words = F.concat(all_of("//MeshHeading/DescriptorName"), all_of("//Keyword"))
    return F.struct(text("//ArticleTitle").alias("title"), authors.alias("authors"), text("//Journal/Title").alias("journal"),
                    year.alias("year"), T.normalize_doi(F.xpath_string(body, F.lit("//ArticleId[@IdType='doi']"))).alias("doi"), distinct_folded(words).alias("keywords"))


def atom(body: Column) -> Column:
    """struct(title, authors, year, doi) of the first entry of an Atom feed (names without prefixes)."""
    return F.struct(T.collapse(F.xpath_string(body, F.lit("//*[local-name()='entry'][1]/*[local-name()='title']"))).alias("title"),
                    F.xpath(body, F.lit("//*[local-name()='entry'][1]/*[local-name()='author']/*[local-name()='name']/text()")).alias("authors"),
                    F.left(F.xpath_string(body, F.lit("//*[local-name()='entry'][1]/*[local-name()='published']")), F.lit(4)).alias("year"),
                    T.normalize_doi(F.xpath_string(body, F.lit("//*[local-name()='entry'][1]/*[local-name()='doi']"))).alias("doi"))


def xmp(body: Column) -> Column:
    """struct(title, authors, journal, year, doi) of an XMP packet; of a packet that is no XML the first year and DOI."""
    def values(packet: Column, name: str) -> Column:
        return F.filter(F.xpath(packet, F.lit(f"//*[local-name()='{name}']//*[local-name()='li']/text()")), lambda v: ~T.is_blank(v))

    def text(packet: Column, *names: str) -> Column:
        return F.coalesce(*(let(T.strip(F.xpath_string(packet, F.lit(f"//*[local-name()='{n}'][1]"))), lambda v: F.when(v != "", v)) for n in names))

    def good(packet: Column) -> Column:
        title = let(F.get(values(packet, "title"), F.lit(0)), lambda t: F.when(T.is_plausible_title(t), T.collapse(t)))
        return F.struct(title.alias("title"), values(packet, "creator").alias("authors"), text(packet, "publicationName", "source").alias("journal"),
                        T.first_year(text(packet, "publicationDate", "coverDate", "date")).alias("year"), T.first_doi(text(packet, "doi", "identifier")).alias("doi"))

    none = F.lit(None).cast("string")
    poor = F.struct(none.alias("title"), F.array().cast("array<string>").alias("authors"), none.alias("journal"), T.first_year(body).alias("year"), T.first_doi(body).alias("doi"))
    found = F.regexp_extract(body, r"(?s)<x:xmpmeta.*?</x:xmpmeta>", 0)
    return let(found, lambda packet: F.when(packet != "", good(packet)).otherwise(poor))


def citation_pdf_url(html: Column, page: Column) -> Column:
    """The first citation_pdf_url of the page's meta tags as an absolute http(s) URL, else null."""
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(tag: Column, name: str) -> Column:
        return F.coalesce(*(F.nullif(F.regexp_extract(tag, r"(?i)[\s\"']" + name + quoted, n), F.lit("")) for n in (1, 2, 3)))

    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"))) == "citation_pdf_url")
    content = F.get(F.filter(F.transform(named, lambda t: T.trim_to_null(attribute(t, "content"))), lambda c: c.isNotNull()), F.lit(0))
    for entity, value in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        content = F.replace(content, F.lit(entity), F.lit(value))
    scheme, root, folder = F.regexp_extract(page, r"^(https?):", 1), F.regexp_extract(page, r"^https?://[^/?#]+", 0), F.regexp_extract(page, r"^https?://[^/?#]+(?:[^?#]*/)?", 0)
    slash = F.when(F.endswith(folder, F.lit("/")), F.lit("")).otherwise(F.lit("/"))
    return (F.when(content.rlike(r"(?i)^https?://"), content).when(content.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None)).when(F.startswith(content, F.lit("//")), F.concat(scheme, F.lit(":"), content))
            .when(F.startswith(content, F.lit("/")), F.concat(root, content)).otherwise(F.concat(folder, slash, content)))


def library_items(rows: DataFrame, body: str) -> DataFrame:
    """Documents of a reference manager's items (JSON): key, version, title, authors, journal, year, doi, keywords, and the keys
    of their PDF attachments in order. Deleted items, other types, items without a title, and those with a title alone are
    left out."""
    m = rows.select(F.from_json(body, ITEM).alias("i")).select("i.key", "i.version", "i.data.*").filter("key IS NOT NULL AND coalesce(deleted, 'false') NOT IN ('true', '1')")
    pick = lambda c: T.trim_to_null(F.col(c))
    name = lambda c: F.coalesce(T.trim_to_null(c["name"]), F.nullif(T.person_name(c["firstName"], c["lastName"]), F.lit("")))
    named = F.filter(F.transform("creators", lambda c: F.struct(c["creatorType"].alias("kind"), name(c).alias("name"))), lambda c: c["name"].isNotNull())
    first = F.transform(F.filter(named, lambda c: c["kind"] == "author"), lambda c: c["name"])
    authors = F.coalesce(F.when(F.size(first) > 0, first).otherwise(F.transform(named, lambda c: c["name"])), F.array().cast("array<string>"))
    kind = F.col("itemType")
    journal = (F.when(kind == "journalArticle", pick("publicationTitle")).when(kind == "conferencePaper", F.coalesce(pick("proceedingsTitle"), pick("publicationTitle")))
               .when(kind == "bookSection", F.coalesce(pick("bookTitle"), pick("publisher"))).when(kind == "book", pick("publisher"))
               .when(kind == "preprint", F.coalesce(pick("repository"), pick("publicationTitle"))).otherwise(F.coalesce(pick("publicationTitle"), pick("publisher"))))
    tags = distinct_folded(F.filter(F.transform("tags", lambda t: T.trim_to_null(t["tag"])), lambda t: t.isNotNull()))
    docs = m.filter(kind.isin(*DOCUMENT_TYPES) & pick("title").isNotNull()).select(
        "key", "version", pick("title").alias("title"), authors.alias("authors"), journal.alias("journal"), F.nullif(F.regexp_extract("date", r"\d{4}", 0), F.lit("")).alias("year"),
        F.lower(T.normalize_doi(F.col("DOI"))).alias("doi"), F.coalesce(tags, F.array().cast("array<string>")).alias("keywords"), pick("ISBN").alias("isbn"))
    docs = docs.filter((F.size("authors") > 0) | F.coalesce("journal", "year", "doi", "isbn").isNotNull()).drop("isbn")
    files = m.filter((kind == "attachment") & (F.col("contentType") == "application/pdf") & F.col("linkMode").isin(*FILE_MODES) & F.col("parentItem").isNotNull())
    files = files.groupBy(F.col("parentItem").alias("key")).agg(F.array_sort(F.collect_list("key")).alias("pdfs"))
    return docs.join(files, "key", "left").withColumn("pdfs", F.coalesce("pdfs", F.array().cast("array<string>")))


def distinct_folded(values: Column) -> Column:
    """Values once each whatever their case, the first spelling kept."""
    def first_of(all_values: Column) -> Column:
        return let(F.transform(all_values, lambda v: F.lower(v)), lambda lower: F.filter(all_values, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1))

    return let(values, first_of)


def settings(rows: DataFrame, key: str = "settingKey", value: str = "value") -> DataFrame:
    """Settings with their decoded JSON (variant), null where the text is none; the raw text stays."""
    return rows.select(key, value, F.try_parse_json(value).alias("decoded"))


def ocr_pages(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, page, markdown, images, blocks) from a list of pages, `layoutParsingResults`, or `pdf_info`; bad input: no rows."""
    # An object read as an array would be one empty page, so the root decides.
    is_list = F.startswith(T.strip(F.col(body)), F.lit("["))
    listed = F.when(is_list, F.from_json(body, f"array<{PAGE}>")).otherwise(F.from_json(body, f"struct<layoutParsingResults:array<{PAGE}>>")["layoutParsingResults"])
    layout = F.from_json(body, LAYOUT)["pdf_info"]
    labels = F.create_map(*(F.lit(x) for pair in LABELS for x in pair))

    def block(b: Column, i: Column) -> Column:
        text = F.array_join(F.transform(b["lines"], lambda n: F.array_join(F.transform(n["spans"], lambda s: s["content"]), "")), "\n")
        return F.struct(i.cast("string").alias("block_id"), F.coalesce(labels[b["type"]], b["type"]).alias("block_label"), text.alias("block_content"), F.transform(b["bbox"], lambda x: 2 * x).alias("block_bbox"),
                        F.lit(None).cast("int").alias("group_id"), F.lit(None).cast("int").alias("global_group_id"), i.cast("int").alias("block_order"), F.lit(None).cast("string").alias("parent_id"))

    a = rows.select(key, F.posexplode(listed).alias("n", "p")).select(
        key, F.col("n").alias("page"), F.col("p.markdown.text").alias("markdown"), F.col("p.markdown.images").alias("images"), F.col("p.prunedResult.parsing_res_list").alias("blocks"))
    b = rows.filter(F.coalesce(F.size(listed), F.lit(0)) <= 0).select(key, F.posexplode(layout).alias("n", "p")).select(
        key, F.coalesce("p.page_idx", "n").alias("page"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("map<string,string>").alias("images"), F.transform("p.para_blocks", block).cast(f"array<{BLOCK}>").alias("blocks"))
    return a.unionByName(b)


def blocks(pages: DataFrame, key: str) -> DataFrame:
    """Blocks as rows, boxes checked: those without a valid one have null edges."""
    box = F.col("b.block_bbox")
    rows = pages.select(key, "page", F.posexplode("blocks").alias("ordinal", "b"))
    edges = [F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("left", "top", "right", "bottom"))]
    return rows.select(F.col(key).alias("doc"), "page", F.coalesce("b.block_id", F.col("ordinal").cast("string")).alias("block"), F.col("b.block_label").alias("label"), F.col("b.block_content").alias("content"), *edges)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Chat sessions of a folder of JSON files, newest first; files that are no JSON are left out."""
    rows = spark.read.schema(SESSION).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return rows.filter("id IS NOT NULL").orderBy(F.desc("updatedAt"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder and below: path, length, modificationTime. Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def package_members(packages: DataFrame) -> DataFrame:
    """(path, name, content) of ZIP packages (path, content): members at or below the folder of the shortest full.md, names
    relative to it; names with .. are refused."""
    def unpacked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if ".." not in n.split("/") and not n.endswith("/")]
                    roots = sorted((n for n in names if n.rsplit("/", 1)[-1] == "full.md"), key=lambda n: (n.count("/"), len(n)))
                    root = roots[0][: -len("full.md")] if roots else ""
                    found = [(path, n[len(root):], z.read(n)) for n in names if n.startswith(root)]
                yield pd.DataFrame(found, columns=["path", "name", "content"])

    return packages.select("path", "content").mapInPandas(unpacked, "path string, name string, content binary")
