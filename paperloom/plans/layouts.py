"""Queries over nested layouts and the metadata of PDF bytes that are made of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.registry import query, table
from paperloom.sources import layouts


@query("""WITH d AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: s <> ''), ' ') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT unnest([0, 1, 2, 3]) AS n)
SELECT doc_id, n, CASE n WHEN 0 THEN 'doc_title' WHEN 1 THEN 'text' WHEN 2 THEN 'figure_title' ELSE 'image' END AS label, CASE n WHEN 0 THEN 'about ' || doc_id WHEN 1 THEN t WHEN 2 THEN 'Figure ' || doc_id ELSE '' END AS content,
  CASE WHEN n = 3 THEN 20.0::DOUBLE END AS left, CASE WHEN n >= 2 THEN 'mu_p0_v2' END AS parent FROM d, p""")
def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a tree: its lines lie at changing depths, in lists and objects of each name."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    quoted = lambda c: F.to_json(F.array(c))

    def node(line, i):
        return (F.when(i % 4 == 0, F.concat(F.lit('{"type":"text","content":'), quoted(line), F.lit("}"))).when(i % 4 == 1, F.concat(F.lit('[{"children":[{"item_content":'), quoted(line), F.lit("}]}]")))
                .when(i % 4 == 2, F.concat(F.lit('{"content":null,"list_items":[7,'), quoted(line), F.lit(',""]}'))).otherwise(quoted(line)))

    lines = F.array_join(F.transform(F.split("text", "\n", -1), node), ",")
    text = F.concat(F.lit('[[{"type":"title","content":{"level":1,"title_content":"about '), F.col("doc_id"), F.lit('"}},{"type":"paragraph","content":{"paragraph_content":['), lines,
                    F.lit(']}},{"type":"image","bbox":[10,20,30,40],"content":{"image_source":{"path":"a.png"},"image_caption":[{"content":"Figure"},{"content":["'), F.col("doc_id"), F.lit('"]}],"image_footnote":[]}}]]'))
    sizes = docs.select("doc_id", F.lit(0).alias("page"), F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))
    out = layouts.nested_blocks(docs.select("doc_id", text.alias("body")), "doc_id", "body", sizes)
    place = F.when(F.col("label") == "image", 3).otherwise(F.col("n"))
    return out.select("doc_id", place.cast("int").alias("n"), "label", "content", "left", "parent")


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x00]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, doc_id % 4 AS form, 'On (' || doc_id || ')' AS title, 2::BIGINT AS authors, nullif(t, '') AS subject FROM d""")
def pdf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the subject in the bytes of a PDF file, in turn as a literal string, with octal escapes, in hexadecimal, and as UTF-16."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("flat", F.regexp_replace("text", r"[\x00]+", " "))
    form = F.col("doc_id") % 4
    bytes_of = lambda c: F.decode(c, "ISO-8859-1")  # noqa: E731  one character a byte
    utf8 = bytes_of(F.encode("flat", "UTF-8"))
    literal = F.concat(F.lit("("), F.regexp_replace(utf8, r"([\\()])", r"\\$1"), F.lit(")"))
    octal = F.concat(F.lit("("), F.replace(F.regexp_replace(utf8, r"([\\()])", r"\\$1"), F.lit("e"), F.lit("\\145")), F.lit(")"))
    hexed = F.concat(F.lit("<"), F.hex(F.encode("flat", "UTF-8")), F.lit(">"))
    wide = F.concat(F.lit("<FE FF"), F.hex(F.encode("flat", "UTF-16BE")), F.lit(">"))
    subject = F.when(form == 0, literal).when(form == 1, octal).when(form == 2, hexed).otherwise(wide)
    data = F.concat(F.lit("%PDF-1.7\n1 0 obj\n<< /Title 5 0 R /Title (On \\("), F.col("doc_id"), F.lit("\\)) /Author (A. One; CNKI and B. T\\167o) /Subject "), subject, F.lit(" >>\nendobj\n"))
    out = layouts.pdf_info(docs.select("doc_id", F.encode(data, "ISO-8859-1").alias("content")), "doc_id", "content")
    return out.select("doc_id", (F.col("doc_id") % 4).alias("form"), "title", F.size("authors").cast("long").alias("authors"), "subject")
