"""Queries over the small library operators, texts and document structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import latex
from paperloom.functions import text as T
from paperloom.operators import captions, history, library, structure
from paperloom.operators.grouped import dealt
from paperloom.plans.reading import _PARAS, paragraphs
from paperloom.plans.registry import query, table
from paperloom.plans.timeline import _LATEST, TODAY, openings


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.by_key(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 42)


@query("""SELECT i.doc_id, (SELECT min(e.doc_id) FROM documents e WHERE e.source < 'src5' AND e.text = i.text) AS known FROM documents i""")
def content_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return library.by_content(docs.select("doc_id", "hash"), docs.filter("source < 'src5'"), "hash", "doc_id").select("doc_id", "known")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE NOT EXISTS
  (SELECT 1 FROM lineitem b WHERE b.l_quantity > 45 AND b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag)""")
def group_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return library.without_groups(lines, lines.filter("l_quantity > 45"), ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH a AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS v FROM lineitem WHERE l_quantity < 30 GROUP BY 1, 2),
b AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_suppkey) AS v FROM lineitem WHERE l_quantity >= 20 GROUP BY 1, 2)
SELECT coalesce(a.o, b.o) AS doc, coalesce(a.n, b.n) AS cell, coalesce(b.v, a.v) AS value FROM a FULL JOIN b ON a.o = b.o AND a.n = b.n""")
def translation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")

    def cells(rows: DataFrame, value: Column) -> DataFrame:
        one = rows.groupBy("l_orderkey", "l_linenumber").agg(value.alias("v"))
        return one.groupBy(F.col("l_orderkey").alias("doc")).agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "v"))).alias("cells"))

    both = library.merged_cells(cells(lines.filter("l_quantity < 30"), F.min("l_partkey")), cells(lines.filter("l_quantity >= 20"), F.max("l_suppkey")), ["doc"], "cells")
    return both.select("doc", F.explode("cells").alias("cell", "value"))


_PATHS = "SELECT page_id, CASE WHEN length(url) % 4 = 0 THEN 'chats/' || page_id || '.json' WHEN length(url) % 4 = 1 THEN page_id || '/.reader.html' WHEN length(url) % 4 = 2 THEN page_id || '/source.pdf' ELSE page_id || '/figures/f.png' END AS path FROM pages"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, page = F.length("url") % 4, F.col("page_id").cast("string")
    path = (F.when(n == 0, F.concat(F.lit("chats/"), page, F.lit(".json"))).when(n == 1, F.concat(page, F.lit("/.reader.html")))
            .when(n == 2, F.concat(page, F.lit("/source.pdf"))).otherwise(F.concat(page, F.lit("/figures/f.png"))))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(f"SELECT page_id, path FROM ({_PATHS}) WHERE path NOT LIKE 'chats/%' OR path LIKE '%/.reader.html'")
def storage_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.cleared(_paths(spark, sf_dir), "path", ("chat",))


@query(f"SELECT page_id, path FROM ({_PATHS}) WHERE path NOT LIKE '%/source.pdf' AND path NOT LIKE '%/figures/%'")
def data_backup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).filter(library.in_data_backup(F.col("path")))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN [] ELSE [c_name, c_mktsegment] END AS authors, make_timestamp(c_custkey * 86400000000) AS "addedAt" FROM customer""")
def stored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    names = F.when(F.col("c_acctbal") < 0, F.lit("broken")).otherwise(F.concat(F.lit('["'), "c_name", F.lit('","'), "c_mktsegment", F.lit('"]')))
    rows = c.select(F.col("c_custkey").alias("id"), names.alias("authors"), (F.col("c_custkey").cast("long") * 86_400_000).alias("addedAt"))
    return library.model(rows, ("authors",), ("addedAt",)).withColumn("addedAt", F.col("addedAt").cast("timestamp_ntz"))


@query("SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS valid FROM customer")
def docs_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = table(spark, sf_dir, "orders").select("o_custkey").distinct().withColumn("contentHash", F.lit("h"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(paid, F.col("id") == F.col("o_custkey"), "left")
    valid, without = library.split_by_file(c)
    return valid.select("id", F.lit(True).alias("valid")).union(without.select("id", F.lit(False).alias("valid")))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def selectable_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return library.selectable(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment") == "BUILDING", linked, "c_custkey").select("c_custkey")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.table_counts({name: table(spark, sf_dir, name) for name in ("documents", "pages")})


@query("""SELECT count(*) FILTER (c_acctbal < 0) AS no_file, count(*) FILTER (c_acctbal >= 0 AND (c_nationkey = 3 OR c_mktsegment = 'BUILDING' OR c_acctbal > 9000)) AS unresolved FROM customer""")
def rebuild_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal")
    docs = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_nationkey") == 3, F.lit(" Untitled-3 ")).otherwise(F.col("c_name")).alias("title"),
                    F.when(F.col("c_mktsegment") == "BUILDING", F.array().cast("array<string>")).otherwise(F.array("c_mktsegment")).alias("authors"), F.lit("2001").alias("year"),
                    F.lit(" ").alias("journal"), F.when(balance <= 9000, F.lit("10.1234/x")).alias("doi"), F.when(balance >= 0, F.lit("h")).alias("contentHash"))
    return library.rebuild_counts(docs)


@query(f"WITH h AS ({_LATEST}) SELECT count(*)::BIGINT AS total FROM h WHERE doc IN (SELECT c_custkey FROM customer)")
def history_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = history.latest(openings(spark, sf_dir), "doc", "ts")
    return library.total(history.sections(opened, table(spark, sf_dir, "customer"), "c_custkey", F.to_date(F.lit(TODAY))), "n_docs")


@query("SELECT user_id, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.last_in_first_place(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("""SELECT l_orderkey AS page, min(l_partkey)::DOUBLE AS "left", min(l_suppkey)::DOUBLE AS top, max(l_partkey + l_quantity)::DOUBLE AS "right", max(l_suppkey + l_quantity)::DOUBLE AS bottom FROM lineitem GROUP BY 1""")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, n = (F.col(c).cast("double") for c in ("l_partkey", "l_suppkey", "l_quantity"))
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), x.alias("left"), y.alias("top"), (x + n).alias("right"), (y + n).alias("bottom"))
    return library.union_boxes(boxes, ["page"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def docs_by_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.by_added(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT n_name, n_regionkey FROM nation ORDER BY n_name = 'FRANCE' DESC, n_regionkey, n_name")
def default_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.default_first(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "n_name", "n_regionkey", "FRANCE")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS kept FROM orders")
def kept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, gone = library.kept_only(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"))
    return kept.select("o_orderkey", F.lit(True).alias("kept")).union(gone.select("o_orderkey", F.lit(False).alias("kept")))


@query("""SELECT (SELECT count(*) FROM customer a FULL JOIN (SELECT * FROM customer WHERE c_custkey <> 7) b ON a.c_custkey = b.c_custkey
  WHERE a.c_name IS DISTINCT FROM b.c_name OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment) > 0 AS due""")
def scheduled_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"), F.col("c_mktsegment").alias("meta"), F.col("c_acctbal").alias("files"))
    return library.backup_due(c, c.filter("id <> 7"), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp"), 86_400)


@query("""SELECT o.o_orderkey AS doc, CASE WHEN l.l_orderkey IS NOT NULL THEN o.o_orderkey || '.mineru.json' END AS path,
  CASE WHEN l.l_orderkey IS NULL AND o.o_orderstatus <> 'F' THEN 'extraction_source_not_found' END AS problem
FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey""")
def extraction_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderstatus") == "F", F.lit("mineru")).alias("active"))
    named = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc")).distinct()
    named = named.select("doc", F.lit("mineru").alias("source"), F.concat(F.col("doc").cast("string"), F.lit(".mineru.json")).alias("path"))
    return library.extraction_source(docs, named, F.lit("mineru")).select("doc", "path", "problem")


@query("""SELECT o_orderkey AS folder FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)""")
def unreferenced_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = lambda c: F.concat(F.lit("g/generation_"), F.col(c).cast("string"))
    g = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("doc"), folder("o_orderkey").alias("folder"))
    r = table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").select((F.col("l_orderkey") % 50).alias("doc"), F.concat(folder("l_orderkey"), F.lit("/img.png")).alias("path"))
    return library.unreferenced(g, r).select(F.regexp_extract("folder", r"\d+$", 0).cast("long").alias("folder"))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN 'edited' ELSE upper(c_name) END AS title, CASE WHEN c_nationkey >= 20 THEN 'mine' ELSE c_mktsegment || '!' END AS journal FROM customer""")
def repaired_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("journal"), F.col("c_nationkey").alias("n"))
    current = c.select("id", F.when(F.col("n") < 12, F.lit("edited")).otherwise(F.col("title")).alias("title"), F.when(F.col("n") >= 20, F.lit("mine")).otherwise(F.col("journal")).alias("journal"))
    repaired = c.select("id", F.upper("title").alias("title"), F.concat("journal", F.lit("!")).alias("journal"))
    return library.repaired_by_background(c, current, repaired, "id", ("title", "journal"))


@query("""SELECT c_nationkey AS query, string_agg('[' || n || '] ' || c_name || chr(10) || 'URL: ' || c_mktsegment || chr(10) || c_nationkey, chr(10) || chr(10) ORDER BY n) AS listing
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) GROUP BY 1""")
def search_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), "c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("url"), F.col("c_nationkey").cast("string").alias("text"))
    return library.result_list(c, "query", "c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND p_type ILIKE '%O%' AND p_name ILIKE '%a%'")
def filtered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumns({"image": F.col("p_size") > 20, "vision": F.col("p_type").ilike("%O%")})
    return library.filtered_ids(p, "p_name", ("image", "vision"), "A").select("p_partkey")


@query("SELECT c_custkey AS key, max(o_orderkey) AS version, (SELECT max(o_orderkey) FROM orders) AS library_version FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def library_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    items = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("key"), F.col("o_orderkey").alias("version"))
    meta = orders.agg(F.max("o_orderkey").cast("string").alias("value")).select(F.lit("v").alias("metaKey"), "value")
    return library.latest_snapshot(items, meta, "key", "v")


# Places in texts -------------------------------------------------------------------------------------------------------


@query(rf"""WITH p AS ({_PARAS}) SELECT doc, paragraph, strpos(text, q) - 1 AS start, strpos(text, q) - 1 + length(q) AS "end" FROM (SELECT *, CASE WHEN length(text) > 7 THEN substr(text, 7, 15) ELSE text END AS q FROM p)""")
def text_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    needle = F.when(F.length("text") > 7, F.substring("text", 7, 15)).otherwise(F.col("text"))
    return p.select("doc", "paragraph", T.find_in_text(F.col("text"), needle).alias("p")).select("doc", "paragraph", F.col("p.start").cast("long").alias("start"), F.col("p.end").cast("long").alias("end"))


@query(rf"""WITH p AS ({_PARAS}), q AS (SELECT *, trim(substr(text, 3, 14)) AS q FROM p)
SELECT doc, paragraph, CASE WHEN q <> '' AND strpos(substr(text, strpos(text, q) + 1), q) = 0 THEN strpos(text, q) - 1 END AS start FROM q""")
def unique_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    needle = F.regexp_replace(F.substring("text", 3, 14), " ", "\n ")
    return p.select("doc", "paragraph", T.unique_place(F.col("text"), needle)["start"].cast("long").alias("start"))


@query(rf"""WITH p AS ({_PARAS}), q AS (SELECT *, CASE WHEN length(text) > 40 THEN substr(text, 6, 9) ELSE text END AS q FROM p),
s AS (SELECT *, strpos(text, q) - 1 AS a FROM q), b AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + length(q) + 1) AS post FROM s)
SELECT doc, paragraph, trim(pre) || trim(q) || trim(post) AS text, length(trim(pre)) AS start, length(trim(pre)) + length(trim(q)) AS "end" FROM b""")
def translation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.length("text") > 40, F.substring("text", 6, 9)).otherwise(F.col("text"))
    p = paragraphs(spark, sf_dir).withColumn("s", T.segmented(F.col("text"), part))
    back = p.select("doc", "paragraph", T.parsed_segments(F.col("s.text"), F.col("s.segment")).alias("b"))
    return back.select("doc", "paragraph", "b.text", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))


@query("""WITH d AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, ((length(t) - length(replace(t, 'tion', ''))) // 4)::BIGINT AS hits, nullif(strpos(t, 'tion'), 0) - 1 AS first,
  CASE WHEN strpos(t, 'tion') > 0 THEN length(substr(t, greatest(strpos(t, 'tion') - 60, 1), least(strpos(t, 'tion') - 1, 60) + 164)) END AS snippet_chars FROM d""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", T.search_hits(F.col("text"), "tion").alias("h"))
    first = F.get("h", F.lit(0))
    return rows.select("conv_id", "turn", F.size("h").cast("long").alias("hits"), first["start"].cast("long").alias("first"), F.length(first["snippet"]).cast("long").alias("snippet_chars"))


@query(r"""WITH u AS (SELECT page_id, 'https://' || CASE WHEN length(url) % 5 = 0 THEN 'arxiv.org/abs/2101.' || page_id WHEN length(url) % 5 = 1 THEN 'www.mdpi.com/1/2/' || page_id || '?type=x'
  WHEN length(url) % 5 = 2 THEN 'www.nature.com/articles/s' || page_id WHEN length(url) % 5 = 3 THEN 'pubs.acs.org/doi/x' ELSE 'example.org/' END AS u FROM pages)
SELECT page_id, CASE WHEN regexp_matches(u, '//arxiv\.org/abs/') THEN replace(u, '/abs/', '/pdf/') WHEN regexp_matches(u, 'mdpi\.com') THEN split_part(u, '?', 1) || '/pdf'
  WHEN regexp_matches(u, 'nature\.com/articles/') THEN u || '.pdf' WHEN regexp_matches(u, 'pubs\.acs\.org') THEN 'https://pubs.acs.org/doi/pdf/10.1/d' || page_id END AS pdf FROM u""")
def publisher_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, page = F.length("url") % 5, F.col("page_id").cast("string")
    rest = (F.when(n == 0, F.concat(F.lit("arxiv.org/abs/2101."), page)).when(n == 1, F.concat(F.lit("www.mdpi.com/1/2/"), page, F.lit("?type=x")))
            .when(n == 2, F.concat(F.lit("www.nature.com/articles/s"), page)).when(n == 3, F.lit("pubs.acs.org/doi/x")).otherwise(F.lit("example.org/")))
    url = F.concat(F.lit("https://"), rest)
    return table(spark, sf_dir, "pages").select("page_id", T.publisher_pdf_url(url, F.concat(F.lit("10.1/d"), page)).alias("pdf"))


@query("""SELECT p_partkey, 'x α' || translate(p_size::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') || '≤10' || translate(p_partkey::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ' $\\frac{a}{' || p_size || '}$' AS text FROM part""".replace("\\\\", "\\"))
def latex_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit(r"x $\alpha_{"), size, F.lit(r"}\leq10^{"), key, F.lit(r"}$ $\frac{a}{"), size, F.lit("}$"))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", latex.simplify_inline(text).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_size < 25 THEN '## ' ELSE '# ' END || CASE WHEN p_size % 2 = 0 THEN '1.2 ' ELSE '' END || p_type || chr(10) || '### Other' || chr(10) || p_name AS md FROM part""")
def section_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("p_size") % 2 == 0, F.lit("1.2 ")).otherwise(F.lit(""))
    md = F.concat(F.lit("# "), number, F.col("p_type"), F.lit("\n### Other\n"), F.col("p_name"))
    titles = F.when(F.col("p_size") < 25, F.array("p_type")).otherwise(F.array(F.lit("none")))
    return table(spark, sf_dir, "part").select("p_partkey", structure.heading_levels(md, titles).alias("md"))


@query(r"""WITH t AS (SELECT doc_id, substr(text, 11) AS rest, substr(text, 1, 10) AS head FROM documents WHERE text IS NOT NULL)
SELECT doc_id, chr(10) || chr(10) || '<!-- reader-pair:' || replace(replace(base64(encode('p?>' || doc_id)), '+', '-'), '/', '_') || ' -->' || chr(10) || chr(10) || head || chr(10) || chr(10) || '<!-- reader-end -->' || chr(10) || chr(10) || rest AS md
FROM t WHERE head <> ''""")
def paragraph_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    head = F.left("text", F.lit(10))
    one = F.struct(F.lit(0).alias("start"), F.length(head).alias("end"), head.alias("text"), F.concat(F.lit("p?>"), F.col("doc_id").cast("string")).alias("id"))
    two = F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit("no").alias("text"), F.lit("overlaps").alias("id"))
    return docs.select("doc_id", structure.marked_paragraphs(F.col("text"), F.array(one, two)).alias("md"))


# Document structure ----------------------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT DISTINCT conv_id AS doc, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, CASE WHEN length(text) % 2 = 0 THEN 'a.png' ELSE 'b.png' END AS name,
  'u' || (length(text) % 3) AS address FROM (SELECT conv_id, turn, coalesce(max(text), '') AS text FROM conversations GROUP BY ALL)),
f AS (SELECT *, first_value(address) OVER (PARTITION BY doc, name ORDER BY page) AS first FROM i)
SELECT doc, page, 'see ' || n || '.' AS markdown, n AS image, address FROM (SELECT *, CASE WHEN address = first THEN name ELSE 'p' || page || '_' || name END AS n FROM f)""")
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc"), F.col("turn").alias("ordinal")).agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    n = F.length("text")
    name = F.when(n % 2 == 0, F.lit("a.png")).otherwise(F.lit("b.png"))
    pages = rows.select("doc", "ordinal", F.concat(F.lit("see "), name, F.lit(".")).alias("markdown"), F.create_map(name, F.concat(F.lit("u"), (n % 3).cast("string"))).alias("images"))
    out = structure.assembled_pages(pages)
    return out.select("doc", F.col("page").cast("long").alias("page"), "markdown", F.explode("images").alias("image", "address"))


_REGION_LINES = """SELECT l_orderkey AS doc, l_linenumber AS page, l_returnflag AS grp, min(l_partkey) AS p, min(l_quantity)::DOUBLE AS h, min(l_suppkey) % 2 = 0 AS filled FROM lineitem GROUP BY 1, 2, 3"""


@query(f"""WITH r AS ({_REGION_LINES}), g AS (SELECT *, count(*) FILTER (filled) OVER w AS owners, count(*) OVER w AS n, sum(10 * h) OVER w AS total,
  max(CASE WHEN filled THEN page END) OVER w AS owner, max(CASE WHEN filled THEN 'text ' || p END) OVER w AS content FROM r WINDOW w AS (PARTITION BY doc, grp))
SELECT doc, owner::BIGINT AS page, page::BIGINT AS region_page, greatest(1, floor(length(content) * (10 * h) / total + 0.5))::BIGINT AS length FROM g WHERE owners = 1 AND n > 1""")
def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("grp")).agg(
        F.min("l_partkey").alias("p"), F.min("l_quantity").cast("double").alias("h"), (F.min("l_suppkey") % 2 == 0).alias("filled"))
    zero = F.lit(0.0)
    blocks = lines.select("doc", "page", F.ascii("grp").alias("ordinal"), F.col("grp").alias("block"), F.lit("text").alias("label"),
                          F.when(F.col("filled"), F.concat(F.lit("text "), F.col("p").cast("string"))).otherwise(F.lit(" ")).alias("content"), F.ascii("grp").alias("global_group"), F.lit(-1).alias("local_group"),
                          zero.alias("left"), zero.alias("top"), F.lit(10.0).alias("right"), F.col("h").alias("bottom"))
    return structure.text_regions(blocks).select("doc", "page", "region_page", "length")


@query(r"""WITH d AS (SELECT doc_id, length(replace(replace(text, '$', ''), '\(', '')) AS n, [length(source), 3, doc_id % 7 + 1] AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, n, list_sum(w) AS t, w[1] AS a, w[1] + w[2] AS b FROM d)
SELECT doc_id, floor(n * a / t + 0.5)::INT AS first, floor(n * b / t + 0.5)::INT AS second, n::INT AS third FROM c""")
def region_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.replace(F.replace(F.col("text"), F.lit("$"), F.lit("")), F.lit("\\("), F.lit(""))  # without marks of formulas, which SQL can't step over
    cut = structure.proportional_ranges(bare, F.array(F.length("source"), F.lit(3), (F.col("doc_id") % 7 + 1).cast("int")))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", cut.alias("r"))
    return docs.select("doc_id", *(F.get("r", F.lit(k))["end"].alias(n) for k, n in enumerate(("first", "second", "third"))))


_FIG = "SELECT DISTINCT l_orderkey AS doc, l_linenumber AS block, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2"


@query(f"""WITH b AS (SELECT doc, block, s % 3 = 0 AS is_table, CASE WHEN p % 4 = 0 THEN '' ELSE 't' || p END AS content FROM ({_FIG})),
f AS (SELECT o_orderkey AS doc, o_orderstatus = 'P' AS stale FROM orders), r AS (SELECT doc, unnest([1, 2, 9]) AS block FROM f WHERE NOT stale),
j AS (SELECT r.doc, bool_or(b.doc IS NULL OR (is_table AND content = '')) AS incomplete, string_agg(CASE WHEN is_table AND content <> '' THEN content END, ',' ORDER BY r.block) AS content FROM r LEFT JOIN b ON r.doc = b.doc AND r.block = b.block GROUP BY 1)
SELECT f.doc, stale, coalesce(incomplete, false) AS incomplete, coalesce(content, '') AS content FROM f LEFT JOIN j USING (doc)""")
def figure_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("block")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    blocks = lines.select("doc", F.lit(0).alias("page"), F.col("block").cast("int").alias("block"), F.when(F.col("s") % 3 == 0, F.lit("table")).otherwise(F.lit("text")).alias("label"),
                          F.when(F.col("p") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("t"), F.col("p").cast("string"))).alias("content"))
    refs = F.array(*(F.struct(F.lit(0).alias("page"), F.lit(k).alias("block")) for k in (1, 2, 9)))
    figures = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("figure"), F.when(F.col("o_orderstatus") == "P", F.lit("old")).otherwise(F.lit("now")).alias("source_version"), refs.alias("refs"))
    return structure.figure_tables(figures, blocks, F.lit("now")).select("doc", "stale", "incomplete", F.array_join("content", ",").alias("content"))


_CAPS = """SELECT p_partkey AS block, CASE WHEN p_size % 5 = 0 THEN 'Figure ' || p_size || '. ' || p_name WHEN p_size % 5 = 1 THEN 'Tabelle ' || p_size || ': ' || p_name WHEN p_size % 5 = 2 THEN '图' || p_size || ' ' || p_name
  WHEN p_size % 5 = 3 THEN 'as Figure ' || p_size || ' shows, ' || p_name ELSE 'Supplementary Table S' || p_size || ' ' || p_name END AS content FROM part"""


@query(rf"""WITH c AS ({_CAPS})
SELECT block, content AS text, CASE WHEN regexp_matches(content, '^(Supplementary )?(Table|Tabelle)') THEN 'table' ELSE 'figure' END AS kind, regexp_matches(content, '^Supplementary') AS supplement
FROM c WHERE regexp_matches(content, '^(Figure|Tabelle|图|Supplementary Table) ?S?\d')""")
def caption_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    n = F.col("p_size") % 5
    text = (F.when(n == 0, F.concat(F.lit("Figure "), size, F.lit(". "), name)).when(n == 1, F.concat(F.lit("Tabelle "), size, F.lit(": "), name)).when(n == 2, F.concat(F.lit("图"), size, F.lit(" "), name))
            .when(n == 3, F.concat(F.lit("as Figure "), size, F.lit(" shows, "), name)).otherwise(F.concat(F.lit("Supplementary Table S"), size, F.lit(" "), name)))
    blocks = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("doc"), F.col("p_partkey").alias("page"), F.col("p_partkey").alias("block"), F.lit("text").alias("label"), text.alias("content"))
    return captions.candidates(blocks).select("block", "text", "kind", "supplement")


@query("""WITH e AS (SELECT l_orderkey AS doc, l_linenumber AS entry, min(l_partkey) % 3 AS x FROM lineitem GROUP BY 1, 2),
l AS (SELECT *, entry - sum(CASE WHEN EXISTS (SELECT 1 FROM e b WHERE b.doc = e.doc AND b.entry = e.entry - 1 AND b.x = e.x) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY entry) AS run FROM e),
r AS (SELECT doc, entry, x, min(entry) OVER (PARTITION BY doc, x, run) AS figure, EXISTS (SELECT 1 FROM e b WHERE b.doc = l.doc AND b.entry = l.entry - 1 AND b.x = l.x) AS follows FROM l)
SELECT doc, entry, figure FROM r""")
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("entry")).agg((F.min("l_partkey") % 3).alias("x"))
    left = F.col("x") * 100.0
    entries = lines.select("doc", "entry", F.col("entry").alias("page"), F.lit("table").alias("kind"), F.lit("Table 2. (continued)").alias("caption"), left.alias("left"), (left + 300).alias("right"),
                           F.concat_ws("/", "doc", "entry").alias("caption_ref"))
    return captions.continued(entries)


@query("""WITH c AS (SELECT l_orderkey % 100 AS doc, count(*) AS captions FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), v AS (SELECT l_orderkey % 100 AS doc, count(DISTINCT (l_orderkey, l_linenumber)) AS clusters FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey % 100 AS doc, count(*) AS paired FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 GROUP BY 1)
SELECT doc, coalesce(captions, 0)::BIGINT AS captions, coalesce(clusters, 0)::BIGINT AS clusters, coalesce(paired, 0)::BIGINT AS paired, (coalesce(clusters, 0) - coalesce(paired, 0))::BIGINT AS dropped FROM v LEFT JOIN c USING (doc) LEFT JOIN p USING (doc)""")
def figure_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("cluster"), "l_returnflag")
    flagged = lines.filter("l_returnflag = 'A'")
    return captions.diagnostics(flagged, lines, flagged.filter("cluster = 1"))


#: Texts without what an alignment passes over, quotes made plain, and the places of the characters that are left.
_GLYPHS = """(SELECT doc, paragraph, text, list_filter(range(length(text)), lambda i: NOT regexp_matches(substr(text, (i + 1)::INT, 1), '[\\s\\x{00AD}-]')) AS spots,
  translate(regexp_replace(text, '[\\s\\x{00AD}-]', '', 'g'), '‘’“”', chr(39) || chr(39) || '""') AS flat,
  translate(regexp_replace(substr(text, 4, 20), '[\\s\\x{00AD}-]', '', 'g'), '‘’“”', chr(39) || chr(39) || '""') AS needle FROM p)"""


@query(rf"""WITH p AS ({_PARAS}), g AS {_GLYPHS}
SELECT doc, paragraph, CASE WHEN needle <> '' THEN spots[strpos(flat, needle)] END AS first, CASE WHEN needle <> '' THEN length(substr(text, 4, 20)) END AS n FROM g WHERE NOT contains(text, '$') AND NOT contains(text, chr(92))""")
def text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where twenty characters of each turn stand in it, by its first occurrence; turns with formulas are another query's."""
    p = paragraphs(spark, sf_dir).filter(~F.contains("text", F.lit("$")) & ~F.contains("text", F.lit("\\")))
    out = structure.alignments(p.select(F.struct("doc", "paragraph").alias("k"), "text", F.substring("text", 4, 20).alias("value")), "k", "value", "text")
    first = F.get(F.filter("places", lambda x: x >= 0), F.lit(0))
    return out.select("k.doc", "k.paragraph", first.cast("long").alias("first"), F.nullif(F.size("places"), F.lit(-1)).cast("long").alias("n"))


@query("""WITH d AS (SELECT doc_id, translate(regexp_replace(text, '[\\s\\x{00AD}-]', '', 'g'), '#$' || chr(92), '') AS flat FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, length(flat)::BIGINT AS n, ((length(flat) + 6) // 7)::BIGINT AS f FROM d)
SELECT doc_id, CASE WHEN (n + f + 1) * (n + 1) <= 9000000 THEN n ELSE 0 END AS placed, CASE WHEN (n + f + 1) * (n + 1) <= 9000000 THEN f ELSE 0 END AS unplaced FROM n""")
def text_alignment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as recognised with a false letter before each seven, aligned with what is printed: all but those. Of texts that are too
    long for a table of nine million cells, none."""
    flat = F.translate(F.regexp_replace("text", r"[\s\u00AD-]", ""), "#$\\", "")
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", flat.alias("printed"), F.regexp_replace(flat, "(?s).{1,7}", "#$0").alias("value"))
    out = structure.alignments(rows, "doc_id", "value", "printed")
    count = lambda sign: F.coalesce(F.size(F.filter("places", sign)), F.lit(0))
    return out.select("doc_id", F.greatest(count(lambda x: x >= 0), F.lit(0)).cast("long").alias("placed"), F.greatest(count(lambda x: x < 0), F.lit(0)).cast("long").alias("unplaced"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS flat, regexp_replace(text, '\\s', '~', 'g') AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT *, substr(flat, greatest(1, length(flat) // 2), 30) AS needle FROM d),
o AS (SELECT *, strpos(flat, needle) - 1 AS spot FROM q WHERE needle <> '' AND len(string_split(flat, needle)) = 2),
p AS (SELECT doc_id, needle, unnest(list_filter(range(length(t)), lambda i: substr(t, (i + 1)::INT, 1) <> '~')[spot + 1:spot + length(needle)]) AS i FROM o)
SELECT doc_id, count(DISTINCT i // 80) AS lines, (min(i // 80) * 12)::DOUBLE AS top, max(i // 80 * 12 + 10)::DOUBLE AS bottom, min(i % 80 * 6)::DOUBLE AS left, max(i % 80 * 6 + 5)::DOUBLE AS right FROM p GROUP BY doc_id""")
def quote_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty letters from the middle of each text, found again on a page that shows it in lines of eighty letters."""
    # Dealt by page before the boxes are made, so the join moves texts, not a box a letter.
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text").repartition("doc_id")

    def glyph(i):
        line, column = F.floor(i / 80).cast("int"), i % 80
        return F.struct((column * 6).cast("double").alias("left"), (line * 12).cast("double").alias("top"), (column * 6 + 5).cast("double").alias("right"), (line * 12 + 10).cast("double").alias("bottom"))

    glyphs = F.when(F.col("text") != "", F.transform(F.sequence(F.lit(0), F.length("text") - 1), glyph))
    pages = docs.select(F.col("doc_id").alias("page"), "text", glyphs.alias("glyphs"))
    flat = F.regexp_replace("text", r"\s+", "")
    middle = F.substr(flat, F.greatest(F.lit(1), F.floor(F.length(flat) / 2).cast("int")), F.lit(30))
    none = F.lit(None).cast("struct<left: double, top: double, right: double, bottom: double>")
    out = structure.quote_boxes(pages, docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page"), middle.alias("quote"), none.alias("within")))
    edge = lambda name, f: f(F.transform("boxes", lambda b: b[name]))
    return out.select(F.col("id").alias("doc_id"), F.size("boxes").cast("long").alias("lines"), edge("top", F.array_min).alias("top"), edge("bottom", F.array_max).alias("bottom"),
                      edge("left", F.array_min).alias("left"), edge("right", F.array_max).alias("right"))


@query(rf"""WITH p AS (SELECT conv_id AS doc, turn, regexp_replace(text, '[\s$]+', '', 'g') AS k FROM conversations WHERE text IS NOT NULL),
e AS (SELECT doc, turn, k, coalesce(sum(length(k)) OVER (PARTITION BY doc ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, string_agg(k, '') OVER (PARTITION BY doc ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS flat FROM p),
c AS (SELECT *, len(string_split(flat, k)) - 1 AS hits, count(*) OVER (PARTITION BY doc, k) AS same, row_number() OVER (PARTITION BY doc, k ORDER BY turn) AS nth FROM e WHERE k <> '')
SELECT doc, turn, CASE WHEN nth = 1 THEN strpos(flat, k) - 1 ELSE (SELECT sum(length(x) + length(k)) - length(k) FROM (SELECT unnest(string_split(flat, k)[1:nth::INT]) AS x)) END::INT AS start FROM c WHERE hits = same""")
def bound_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation, bound to its whole text as it is shown; nothing in it is marked."""
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), "text")
    views = turns.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t")).select("doc", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    none = F.lit(None).cast("int")
    out = structure.bound_paragraphs(views, turns.select("doc", "n", F.col("n").alias("id"), F.lit("source").alias("language"), "text", none.alias("start"), none.alias("end")))
    return out.select("doc", F.col("id").alias("turn"), F.col("start").cast("int").alias("start"))


@query()
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of synthetic pages as runs of lines."""
    x, y = F.col("l_linenumber") * 40.0, (F.col("l_partkey") % 3) * 20.0
    boxes = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("doc"), F.col("l_orderkey").alias("page"), x.alias("left"), y.alias("top"), (x + 35).alias("right"), (y + 12).alias("bottom"))
    return structure.line_runs(boxes)


@query("""SELECT DISTINCT doc, block, CASE WHEN k = 1 THEN pg ELSE region_page END AS region_page FROM (
  SELECT o_orderkey AS doc, 'o' AS block, 9::BIGINT AS region_page, (SELECT count(*) FROM (SELECT l_linenumber, min(l_quantity) q FROM lineitem WHERE l_orderkey = o_orderkey GROUP BY 1) WHERE q < 25) AS k,
    (SELECT min(l_linenumber) FROM (SELECT l_linenumber, min(l_quantity) q FROM lineitem WHERE l_orderkey = o_orderkey GROUP BY 1) WHERE q < 25) AS pg FROM orders)""")
def region_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    box = [F.lit(v).alias(c) for v, c in zip((0.0, 0.0, 100.0), ("left", "top", "right"), strict=True)]
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("page"), F.lit("o").alias("block"), F.lit("text").alias("label"), F.lit("filled").alias("content"), *box, F.lit(50.0).alias("bottom"))
    rest = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_linenumber").cast("long").alias("page"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("block"), F.lit("text").alias("label"),
                        F.lit(" ").alias("content"), *box, F.when(F.col("q") < 25, F.lit(60.0)).otherwise(F.lit(90.0)).alias("bottom"))
    regions = own.select("doc", "block", F.lit(1).alias("part"), F.lit(9).cast("long").alias("region_page"), *box, F.lit(50.0).alias("bottom"))
    return structure.repaired_regions(own.unionByName(rest), regions).select("doc", "block", "region_page")
