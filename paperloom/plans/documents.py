"""Queries over documents, pages, conversations and layout rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import documents, layout
from paperloom.plans.registry import query, table

_CHUNKS = """SELECT o_orderkey, i AS index, CASE WHEN n <= 200 THEN 1 ELSE i * 200 + 1 END::INT AS start_page, CASE WHEN n <= 200 THEN n ELSE least(n, (i + 1) * 200) END::INT AS end_page, n <= 200 AS whole_file
FROM (SELECT o_orderkey, n, unnest(range(0, CASE WHEN n <= 200 THEN 1 ELSE ((n + 199) // 200)::INT END))::INT AS i FROM (SELECT o_orderkey, (o_orderkey % 1000 + 1)::INT AS n FROM orders))"""


@query(_CHUNKS)
def page_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000 + 1).cast("int").alias("n"))
    return layout.page_chunks(rows, "n").select("o_orderkey", "index", "start_page", "end_page", "whole_file")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN d BETWEEN (b - 1) AND (b - 1) + 199 THEN d ELSE (b - 1) + l_linenumber END::BIGINT AS page FROM
  (SELECT l_orderkey, l_linenumber, l_partkey % 400 AS d, (l_orderkey % 4) * 200 + 1 AS b FROM lineitem)""")
def page_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_orderkey") % 4) * 200 + 1
    page = layout.global_page(F.col("l_partkey") % 400, F.col("l_linenumber"), start, F.lit(200))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", page.cast("bigint").alias("page"))


_MD = "concat('# Title ', doc_id, chr(10), chr(10), text, chr(10), chr(10), CASE doc_id % 3 WHEN 0 THEN '## References' WHEN 1 THEN '## 5. Funding statement' ELSE '## Notes' END, chr(10), 'Item ', doc_id)"


@query("""WITH h AS (SELECT doc_id, length('# Title ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10)) AS start,
  length(CASE WHEN doc_id % 3 = 0 THEN '## References' ELSE '## 5. Funding statement' END || chr(10) || 'Item ' || doc_id) AS rest FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 2)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'references' ELSE 'funding' END AS section, ('Item ' || doc_id) AS content FROM h WHERE doc_id % 3 = 0 OR start >= floor((start + rest) * 0.5)""")
def back_matter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over texts of any length; where a short text puts a heading too early, it is no section."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MD).alias("md"))
    found = documents.back_matter(docs, "doc_id", "md").join(docs, "doc_id")
    return found.select("doc_id", "section", F.substr("md", F.col("content_start") + 1, F.col("content_end") - F.col("content_start")).alias("content"))


# In SQL a skipped range becomes one character, which marks every paragraph that it touches.
@query(r"""WITH m AS (SELECT doc_id, trim(text, chr(10) || ' ') || chr(10) || chr(10) || 'Second ' || doc_id AS md FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, regexp_replace(regexp_replace(md, '(?m)^[ \t]*(?:```[^\n]*\n[\s\S]*?\n[ \t]*```|~~~[^\n]*\n[\s\S]*?\n[ \t]*~~~)[ \t]*$', chr(1), 'g'), '\$\$[\s\S]*?\$\$', chr(1), 'g') AS md FROM m),
p AS (SELECT doc_id, trim(unnest(regexp_split_to_array(md, '\n[ \t]*\n')), chr(10) || chr(9) || chr(13) || ' ') AS p FROM s)
SELECT doc_id, count(*)::BIGINT AS n, sum(length(p))::BIGINT AS chars FROM p WHERE p <> '' AND NOT contains(p, chr(1)) AND NOT regexp_matches(p, '^!\[[^\]]*\]\([^)]*\)[ \t]*$')
  AND NOT regexp_matches(p, '(?m)^\s*\|[- :|]+\|\s*$') GROUP BY doc_id""")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all texts, those with code, formulas and tables as well."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.trim(F.col("text"), F.lit("\n ")), F.lit("\n\nSecond "), F.col("doc_id")).alias("md"))
    return documents.paragraphs(docs, "doc_id", "md").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, (l_partkey % 500)::INT AS s, (l_partkey % 500 + l_quantity)::INT AS e FROM lineitem)
SELECT doc, n FROM r a WHERE n % 2 = 1 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.n % 2 = 0 AND b.doc = a.doc AND a.s < b.e AND a.e > b.s)""")
def range_overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_partkey") % 500).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), start.alias("start"), (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("int").alias("end"))
    return documents.outside(rows.filter("n % 2 = 1"), rows.filter("n % 2 = 0").drop("n"), "doc").select("doc", "n")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages WHERE html IS NOT NULL")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", documents.html_title(F.col("html")).alias("title"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages WHERE html IS NOT NULL),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
SELECT page_id, left(trim(regexp_replace(t, '[\s\x{00A0}\x{0085}]+', ' ', 'g')), 10000) AS text FROM b""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", documents.html_text(F.col("html")).alias("text"))


@query(r"""WITH u AS (SELECT page_id, list_transform(regexp_extract_all(url || ' see ' || url || ', and https://x.org/' || page_id || '.', 'https?://[^\s<>"'')\]]+'), lambda x: regexp_replace(x, '[.,;:!?]+$', '')) AS l FROM pages)
SELECT page_id, l[1] AS first, CASE WHEN l[1] = l[3] THEN NULL ELSE l[3] END AS second FROM u""")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("url"), F.lit(" see "), F.col("url"), F.lit(", and https://x.org/"), F.col("page_id").cast("string"), F.lit("."))
    return table(spark, sf_dir, "pages").select("page_id", T.urls(text).alias("u")).select("page_id", F.get("u", F.lit(0)).alias("first"), F.get("u", F.lit(1)).alias("second"))


@query(r"""WITH c AS (SELECT conv_id, turn, nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS t FROM conversations)
SELECT conv_id, turn, 'see https://x.org' || chr(10) || chr(10) || CASE WHEN t IS NULL THEN '' ELSE '> ' || replace(t, chr(10), chr(10) || '> ') || chr(10) || chr(10) END || 'Why ' || turn || '?' AS message FROM c""")
def chat_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.compose_chat(F.lit("see https://x.org"), F.col("text"), F.concat(F.lit(" Why "), F.col("turn"), F.lit("? "))).alias("message"))


def _redaction_sql() -> str:
    """The redaction steps in SQL. URLs are taken apart and put back between the texts around them."""
    plain = lambda p: p.replace("++", "+").replace("*+", "*").replace("'", "''")
    text = "array_to_string(list_transform(range(1, len(around) + 1), lambda i: around[i] || coalesce(urls[i], '')), '')"
    for pattern, new in ((T.LOGIN, r"\1 [REDACTED]"), (T.SECRET_ASSIGNMENT, r"\1[REDACTED]"), (T.TOKEN, "[REDACTED]"), (T.HOME, "<USER_HOME>")):
        text = f"regexp_replace({text}, '{plain(pattern)}', '{new}', 'g')"
    read = "try(url_decode(replace(regexp_extract(p, '^[^=]*'), '+', ' ')))"
    name = f"CASE WHEN contains({read}, chr(65533)) IS DISTINCT FROM false THEN regexp_extract(p, '^[^=]*') ELSE replace(url_encode({read}), '%20', '+') END"
    return f"""WITH t AS (SELECT doc_id, text || ' api_key = abc' || doc_id || '; Bearer x' || doc_id || ' in /home/u' || doc_id || '/f' AS t FROM documents),
a AS (SELECT doc_id, regexp_split_to_array(t, '{plain(T.WEB_ADDRESS)}') AS around, list_transform(regexp_extract_all(t, '{plain(T.WEB_ADDRESS)}'),
  lambda u: {{'url': u, 'parts': regexp_extract(u, '{plain(T.ADDRESS_PARTS)}', ['scheme', 'who', 'host', 'path', 'asked'])}}) AS found FROM t),
n AS (SELECT doc_id, around, list_transform(found, lambda f: {{'url': f.url, 'parts': f.parts,
  'names': list_transform(list_filter(string_split(substr(f.parts.asked, 2), '&'), lambda p: p <> ''), lambda p: {name})}}) AS found FROM a),
r AS (SELECT doc_id, around, list_transform(found, lambda f: CASE WHEN NOT regexp_full_match(f.parts.host, '{plain(T.HOST_AND_PORT)}') THEN '[REDACTED_URL]'
  WHEN length(f.parts.who) > 1 OR contains(f.url, '?') OR contains(f.url, '#') THEN f.parts.scheme || f.parts.host || f.parts.path || left(f.parts.asked, 1)
    || array_to_string(list_transform(list_filter(f.names, lambda x, i: list_position(f.names, x) = i), lambda x: x || '=%5BREDACTED%5D'), '&') ELSE f.url END) AS urls FROM n)
SELECT doc_id, {text} AS text FROM r"""


@query(_redaction_sql())
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the documents, each with a key, a token and a folder more, redacted."""
    n = F.col("doc_id").cast("string")
    text = F.concat("text", F.lit(" api_key = abc"), n, F.lit("; Bearer x"), n, F.lit(" in /home/u"), n, F.lit("/f"))
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_credentials(text).alias("text"))


@query("SELECT doc_id, text, true AS same FROM documents WHERE text IS NOT NULL")
def mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", documents.masked(F.col("text")).alias("m"))
    back = documents.unmasked(F.col("m.masked"), F.col("m.spans"))
    return docs.select("doc_id", back.alias("text"), (back == F.col("text")).alias("same"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN false ELSE true END AS usable FROM customer")
def usable_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' (A and b) ' WHEN 1 THEN c_name WHEN 2 THEN 'Figure 1' ELSE 'ab' END")
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_usable_caption(text).alias("usable"))


@query("""SELECT p_partkey, '| ' || p_brand || ' | ' || p_size || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a\\|b | ' || p_type || ' |' AS md, p_brand || chr(9) || p_size || chr(10) || 'a|b' || chr(9) || p_type AS tsv FROM part""")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lit("\n")
    md = F.concat(F.lit("|"), F.col("p_brand"), F.lit("|"), F.col("p_size").cast("string"), F.lit("|"), n, F.lit("|---|:---:|"), n, F.lit("| a\\|b |"), F.col("p_type"), F.lit(" |"))
    rows = table(spark, sf_dir, "part").select("p_partkey", documents.pipe_table(md).alias("t"))
    return rows.select("p_partkey", documents.table_markdown(F.col("t")).alias("md"), documents.table_tsv(F.col("t")).alias("tsv"))


_LINES = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of synthetic pages from order lines: one order is a page. Pages are dealt out once; all steps on a page stay there."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), "l_partkey", "l_suppkey", "l_returnflag")
    lines = rows.repartition("doc", "page").groupBy("doc", "page", "block").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")))
    left, top = (F.col("l_partkey") % 2) * 500.0 + 50, F.col("block") * 120.0
    label = F.when(F.col("l_suppkey") % 3 == 0, "image").otherwise("text")
    return lines.select("doc", "page", "block", label.alias("label"), left.alias("left"), top.alias("top"), (left + 350).alias("right"), (top + 100).alias("bottom"), F.col("l_returnflag").alias("content"))


@query(f"""WITH b AS (SELECT l_orderkey AS page, (l_partkey % 2) * 500.0 + 50 AS l, l_suppkey % 3 <> 0 AS t FROM ({_LINES})),
p AS (SELECT page, min(l) AS pl, max(l) + 350 AS pr FROM b GROUP BY page),
s AS (SELECT b.page, count(*) FILTER (t AND l + 350 <= (pl + pr) / 2 + 30) AS nl, count(*) FILTER (t AND l >= (pl + pr) / 2 - 30) AS nr FROM b JOIN p USING (page) GROUP BY b.page)
SELECT page, nl >= 3 AND nr >= 3 AS is_double FROM s""")
def columns_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.columns(_boxes(spark, sf_dir)).select("page", "is_double")


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS page, l_linenumber AS block, (l_partkey % 2) * 500.0 + 50 AS l, l_linenumber * 120.0 AS t, l_suppkey % 3 = 0 AS v FROM ({_LINES})),
d AS (SELECT page, sqrt(pow(max(l) + 350 - min(l), 2) + pow(max(t) + 100 - min(t), 2)) AS diagonal FROM b GROUP BY 1),
g AS (SELECT x.page, x.block, y.block AS other, x.t AS t1, y.t AS t2, sqrt(pow(greatest(0, x.l - y.l - 350, y.l - x.l - 350), 2) + pow(greatest(0, x.t - y.t - 100, y.t - x.t - 100), 2)) AS gap
  FROM b x JOIN b y ON x.page = y.page AND x.block <> y.block AND x.v AND y.v),
e AS (SELECT g.page, block, other FROM g JOIN d USING (page) WHERE gap <= diagonal * 0.06 OR (abs(t1 - t2) < 12 AND gap <= 350 * 0.3)),
c AS (SELECT page, block, block AS other FROM b WHERE v UNION SELECT c.page, c.block, e.other FROM c JOIN e ON c.page = e.page AND c.other = e.block)
SELECT page % 100 AS doc, page, block, min(other) AS cluster FROM c GROUP BY ALL""")
def cluster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clusters(_boxes(spark, sf_dir))


@query()
def pair_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _boxes(spark, sf_dir)
    captions = blocks.filter("label = 'text' AND block % 2 = 0").withColumn("kind", F.lit("figure"))
    return layout.caption_pairs(blocks, captions)


@query(f"""SELECT doc, page, block FROM (SELECT l_orderkey % 100 AS doc, l_orderkey AS page, l_linenumber AS block, count(*) OVER (PARTITION BY l_orderkey % 100, l_suppkey % 3 = 0, l_returnflag) AS n,
  min(l_orderkey) OVER (PARTITION BY l_orderkey % 100, l_suppkey % 3 = 0, l_returnflag) AS a, max(l_orderkey) OVER (PARTITION BY l_orderkey % 100, l_suppkey % 3 = 0, l_returnflag) AS z FROM ({_LINES})) WHERE a <> z""")
def header_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_headers(_boxes(spark, sf_dir)).select("doc", "page", "block")


@query()
def reflowed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", documents.reflowed("text").alias("text"))
