"""Queries over record readers, Markdown clean-up, merges and events that other modules have no query for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import documents, layout, linkage, merge, reader, search, store
from paperloom.operators.grouped import dealt
from paperloom.plans.documents import _LINES, _boxes
from paperloom.plans.registry import query, table
from paperloom.sources import records
from paperloom.streaming import views


def joined(*parts: str | Column) -> Column:
    """Literals and columns as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Records ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN user_id WHEN event_type = 'view' THEN NULL END AS number, event_type <> 'view' AS decoded FROM events")
def settings_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "click", joined('{"n": ', F.col("user_id"), "}")).when(F.col("event_type") == "view", F.lit("{plain")).otherwise(F.lit("[true]"))
    rows = records.settings(e.select(F.col("event_id").alias("settingKey"), value.alias("value")))
    return rows.select(F.col("settingKey").alias("event_id"), F.try_variant_get("decoded", "$.n", "bigint").alias("number"), F.col("decoded").isNotNull().alias("decoded"))


@query("""SELECT o_orderkey AS doc, CASE WHEN o_orderstatus = 'F' THEN 'text' ELSE 'paragraph_title' END AS label, 'c' || o_custkey AS content, CASE WHEN o_orderstatus = 'F' THEN 3.0 ELSE 6.0 END::DOUBLE AS "right" FROM orders WHERE o_orderstatus <> 'P'""")
def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    listed = joined('[{"prunedResult":{"parsing_res_list":[{"block_id":"1","block_label":"text","block_bbox":[0,0,3,1],"block_content":"c', F.col("o_custkey"), '"}]}}]')
    flat = joined('{"pdf_info":[{"page_idx":0,"para_blocks":[{"type":"title","bbox":[1,2,3,4],"lines":[{"spans":[{"type":"text","content":"c"},{"type":"text","content":"', F.col("o_custkey"), '"}]}]}]}]}')
    body = F.when(F.col("o_orderstatus") == "F", listed).when(F.col("o_orderstatus") == "P", F.lit("{broken")).otherwise(flat)
    pages = records.ocr_pages(o.select(F.col("o_orderkey").alias("key"), body.alias("body")), "key", "body")
    return records.blocks(pages, "key").select("doc", "label", "content", "right")


@query("""SELECT p_partkey, p_name AS title, p_brand || ' ' || p_type AS author, (1950 + p_size)::VARCHAR AS year, '10.1234/' || p_partkey AS doi FROM part""")
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = joined('{"title":["', F.col("p_name"), '"],"author":[{"given":" ', F.col("p_brand"), '","family":"', F.col("p_type"), '"}],"DOI":"https://doi.org/10.1234/', F.col("p_partkey"), '","published-print":{"date-parts":[[', F.col("p_size") + 1950, "]]}}")
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", records.crossref(body).alias("r"))
    return rows.select("p_partkey", "r.title", F.get("r.authors", F.lit(0)).alias("author"), "r.year", "r.doi")


@query("""SELECT p_partkey, p_name AS title, p_type || ' ' || p_brand AS author, CASE WHEN p_size > 25 THEN '2001' ELSE '1999' END AS year, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS keywords FROM part""")
def pubmed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("p_size") > 25, F.lit("<Year>2001</Year>")).otherwise(F.lit("<MedlineDate>1999 Jan-Feb</MedlineDate>"))
    word = F.when(F.col("p_size") % 2 == 0, F.lit("CELL")).otherwise(F.lit("Other"))
    body = joined("<A><ArticleTitle>", F.col("p_name"), "</ArticleTitle><Author><LastName>", F.col("p_brand"), "</LastName><ForeName>", F.col("p_type"), "</ForeName></Author><PubDate>", date, "</PubDate><Keyword>Cell</Keyword><Keyword>", word, "</Keyword></A>")
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", records.pubmed(body).alias("r"))
    return rows.select("p_partkey", "r.title", F.get("r.authors", F.lit(0)).alias("author"), "r.year", F.size("r.keywords").alias("keywords"))


@query("SELECT p_partkey, p_name AS title, p_brand AS author, (2000 + p_size)::VARCHAR AS year FROM part")
def atom_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = joined("<feed><entry><title> ", F.col("p_name"), "\n</title><author><name>", F.col("p_brand"), "</name></author><published>", F.col("p_size") + 2000, "-01-02</published></entry><entry><title>no</title></entry></feed>")
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", records.atom(body).alias("r"))
    return rows.select("p_partkey", "r.title", F.get("r.authors", F.lit(0)).alias("author"), "r.year")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS title, (1990 + p_size % 30)::VARCHAR AS year FROM part")
def xmp_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.col("p_size") % 30 + 1990
    packet = joined("..<x:xmpmeta xmlns:x='x' xmlns:d='d' xmlns:r='r'><d:title><r:li>", F.col("p_name"), "</r:li></d:title><d:date>", year, "-05</d:date></x:xmpmeta>")
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", records.xmp(F.when(F.col("p_size") % 2 == 0, packet).otherwise(joined("raw ", year))).alias("r"))
    return rows.select("p_partkey", "r.title", "r.year")


@query("""SELECT p_partkey AS key, p_name AS title, p_size AS n_files FROM (SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS p_size, p_type FROM part) WHERE p_type <> 'PROMO'""")
def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type") == "PROMO", F.lit("note")).otherwise(F.lit("journalArticle"))
    items = p.select(joined('{"key":"', F.col("p_partkey"), '","version":1,"data":{"itemType":"', kind, '","title":"', F.col("p_name"), '","date":"May 2001"}}').alias("b"))
    files = p.filter("p_size > 25").select(joined('{"key":"f', F.col("p_partkey"), '","data":{"itemType":"attachment","contentType":"application/pdf","linkMode":"imported_file","parentItem":"', F.col("p_partkey"), '"}}').alias("b"))
    out = records.library_items(items.union(files), "b")
    return out.select(F.col("key").cast("bigint").alias("key"), "title", F.size("pdfs").alias("n_files"))


@query("SELECT conv_id, turn, '{\"t\":' || turn || '}' AS data FROM conversations")
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = joined('data: {"t":', F.col("turn"), "}\n\ndata: [DONE]\n\ndata: {broken\n\n: comment\n\n")
    return views.sse_deltas(table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("value"))).select("conv_id", "turn", "data")


@query("""SELECT page_id, CASE WHEN length(url) % 3 = 0 THEN 'https://h.org/a.pdf?x=1&y' WHEN length(url) % 3 = 1 THEN 'https://h.org/p/b' || page_id || '.pdf' END AS pdf FROM pages""")
def citation_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("url") % 3
    html = F.when(n == 0, F.lit("<meta name=citation_pdf_url content='/a.pdf?x=1&amp;y'>")).when(n == 1, joined('<META content="b', F.col("page_id"), '.pdf" NAME="Citation_PDF_URL">')).otherwise(F.lit('<meta name="other" content="u">'))
    return table(spark, sf_dir, "pages").select("page_id", records.citation_pdf_url(html, F.lit("https://h.org/p/q?z")).alias("pdf"))


# Fields ----------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'doi' WHEN p_size % 3 = 1 THEN 'arxiv' END AS type, CASE WHEN p_size % 3 = 0 THEN '10.1234/ab' || p_partkey WHEN p_size % 3 = 1 THEN '2101.' || lpad(p_size::VARCHAR, 5, '0') END AS value FROM part")
def text_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 3
    text = F.when(n == 0, joined("see 10.1234/ab", F.col("p_partkey"), ", and more")).when(n == 1, joined("in arXiv: 2101.", F.lpad(F.col("p_size").cast("string"), 5, "0"), ".")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.identifier_in_text(text).alias("i")).select("p_partkey", "i.type", "i.value")


@query(r"SELECT doc_id, nullif(regexp_extract(text, '(19|20)\d{2}'), '') AS year, regexp_matches(coalesce(text, ''), '\b(19|20)\d{2}\b|(?i:doi)|https?://') AS reference FROM documents WHERE text IS NOT NULL")
def years_and_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.first_year(F.col("text")).alias("year"), T.looks_like_reference(F.col("text")).alias("reference"))


@query("SELECT p_partkey, '10.1234/x' || p_partkey AS doi FROM part")
def first_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", T.first_doi(joined("at http://dx.doi.org/10.1234/x", F.col("p_partkey"), ". and 10.9999/no")).alias("doi"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN c_name ELSE trim(c_mktsegment) END AS value FROM customer")
def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("c_nationkey") < 10, joined(" ", F.col("c_name"), " ")).otherwise(F.lit(" \t"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.overlay(first, F.col("c_mktsegment")).alias("value"))


@query("SELECT c_custkey, c_custkey || '-' || c_mktsegment || '-' || replace(c_name, '#', 'x') || 'ab.pdf' AS name FROM customer")
def pdf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = joined(F.replace(F.col("c_name"), F.lit("#"), F.lit("x")), 'a:?"b')
    return table(spark, sf_dir, "customer").select("c_custkey", T.pdf_file_name(F.col("c_custkey").cast("string"), joined("Ann  ", F.col("c_mktsegment")), title).alias("name"))


@query(r"SELECT doc_id, sha256(text) AS revision, left(sha256(text), 24) AS file, regexp_replace(coalesce(text, ''), '[^一-鿿㐀-䶿]', '', 'g') <> '' AND length(regexp_replace(text, '[^一-鿿㐀-䶿]', '', 'g')) >= 3 AS chinese FROM documents WHERE text IS NOT NULL")
def text_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", T.text_revision(F.col("text")).alias("revision"), T.file_hash(F.encode("text", "UTF-8")).alias("file"), T.is_chinese(F.col("text")).alias("chinese"))


@query("SELECT page_id, 'a b/' || page_id AS path, 'Dear ' || page_id || ', ' || page_id AS letter FROM pages")
def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", T.source_path(joined(".\\a%20b\\", page)).alias("path"), T.render(F.lit("Dear {{n}}, {{n}}"), {"n": page}).alias("letter"))


@query("SELECT conv_id, turn, ['one', 'turn ' || turn] AS lines FROM conversations")
def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.changelog_lines(joined("# v\n- one\r\n -  turn ", F.col("turn"), " \nnot")).alias("lines"))


@query("SELECT p_partkey, CASE WHEN upper(p_brand) = upper(p_type) THEN [p_brand] ELSE [p_brand, p_type] END AS words FROM part")
def folded_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.distinct_folded(F.array("p_brand", F.lower("p_brand"), "p_type", F.upper("p_brand"))).alias("words"))


@query("SELECT a.p_partkey, a.p_type = b.p_type AND a.p_size = b.p_size AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def same_core_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")

    def side(shift: int, pad: str) -> DataFrame:
        return p.select((F.col("p_partkey") - shift).alias("key"), joined(pad, F.col("p_type")).alias("title"), F.lit(None).cast("string").alias("journal"), F.col("p_size").cast("string").alias("year"), F.lit(pad).alias("doi"), F.array(joined("A", pad)).alias("authors"))

    return side(0, "").alias("a").join(side(1, " ").alias("b"), F.col("a.key") == F.col("b.key")).select(F.col("a.key").alias("p_partkey"), linkage.same_core("a", "b").alias("same"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%ation%' OR source ILIKE '%ation%' OR contains('ation source', lower(lang))")
def any_field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("tags", F.array(F.when(F.contains(F.lit("ation source"), F.lower("lang")), F.lit("Ation"))))
    return d.filter(search.any_field("ATION", ("text", "source"), ("tags",))).select("doc_id")


# Merges ----------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey < 12 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_nationkey >= 12 AND c_acctbal > 0""")
def insert_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    new = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"))
    return store.insert_ignore(c.filter("c_nationkey < 12").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), new.union(new), ["id"])


@query("SELECT name FROM (SELECT 'backup-' || o_orderdate || '-' || o_orderkey || '.zip' AS name FROM orders WHERE o_orderstatus = 'F') ORDER BY name DESC OFFSET 3")
def pruned_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("o_orderstatus") == "F", F.lit(".zip")).otherwise(F.lit(".tmp"))
    return store.prune_names(table(spark, sf_dir, "orders").select(joined("backup-", F.col("o_orderdate"), "-", F.col("o_orderkey"), ending).alias("name")), "name", r"^backup-.*\.zip$")


@query("SELECT DISTINCT favoriteId, docId FROM (SELECT o_custkey % 7 AS \"favoriteId\", o_orderkey AS \"docId\" FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey % 7, o_orderkey // 2 FROM orders WHERE o_orderstatus = 'O')")
def favorite_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("favoriteId"), F.col("o_orderkey").alias("docId"), "o_orderstatus")
    live, backup = (o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O"))
    id_map = o.filter("o_orderstatus <> 'P'").select(F.col("docId").alias("old"), F.expr("docId div 2").alias("new"))
    return merge.favourite_members(live, backup, id_map)


@query("""SELECT DISTINCT o.o_custkey AS "docId", 'f' || l_linenumber AS path FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey WHERE l_returnflag = 'A' AND NOT EXISTS
  (SELECT 1 FROM lineitem m JOIN orders q ON m.l_orderkey = q.o_orderkey WHERE m.l_returnflag <> 'A' AND q.o_custkey = o.o_custkey AND m.l_linenumber = lineitem.l_linenumber)""")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("docId"), joined("f", F.col("l_linenumber")).alias("path"), "l_returnflag")
    id_map = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("old"), F.col("o_custkey").alias("new"))
    live = merge.remapped(lines.filter("l_returnflag <> 'A'"), id_map, "docId")
    return merge.missing_files(live, lines.filter("l_returnflag = 'A'"), id_map).select("docId", "path")


@query("SELECT user_id, event_id, event_id < max(event_id) OVER (PARTITION BY user_id, event_type) AS superseded FROM events")
def superseded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    return views.newest_write(e, "key", "event_id").select("user_id", "event_id", "superseded")


@query("""SELECT l_orderkey AS stream, l_linenumber AS index, arg_min(l_returnflag, (l_partkey, l_suppkey, l_returnflag)) FILTER (l_returnflag <> 'N') AS name, string_agg(l_partkey::VARCHAR || ',', '' ORDER BY l_partkey, l_suppkey) AS arguments
FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_returnflag <> 'N') > 0""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("index"), F.struct("l_partkey", "l_suppkey", "l_returnflag").alias("n"),
                                                   F.lit("i").alias("id"), name.alias("name"), joined(F.col("l_partkey"), ",").alias("arguments"))
    return views.tool_calls(rows, "stream", "index", "n").select("stream", "index", "name", "arguments")


@query("""SELECT o_orderkey AS doc, string_agg('part ' || l_linenumber || ' ' || q, chr(10) || chr(10) ORDER BY l_linenumber) AS markdown FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey GROUP BY 1""")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("index")).agg(F.min("l_quantity").cast("int").alias("q"))
    return layout.merged_markdown(lines.select("doc", "index", joined("part ", F.col("index"), " ", F.col("q"), " \n").alias("markdown")), "doc")


# Markdown --------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '# ' || p_name || ' deep' || chr(10) || 'text' ELSE '# Journal' || chr(10) || '## Unrelated' || chr(10) || 'text' END AS md FROM part""")
def title_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    md = F.when(even, joined("# Journal\nx\n# ", F.col("p_name"), " deep\ntext")).otherwise(F.lit("# Journal\n## Unrelated\ntext"))
    return table(spark, sf_dir, "part").select("p_partkey", documents.before_title_dropped(md, F.when(even, F.upper("p_name")).otherwise(F.lit("Nothing alike"))).alias("md"))


@query("""SELECT p_partkey, 'a' || chr(10) || CASE WHEN p_size % 2 = 0 THEN chr(10) || '$$' || chr(10) || 'x=' || p_size || chr(10) || '$$' || chr(10) ELSE '$y' || p_size || '$' END || chr(10) || 'b $z$' AS promoted,
  'n<sup>' || p_size || '</sup> m' AS raised, '*Note ' || p_size || '*(a)' AS divs, '⁦$x' || p_size || '$⁩ and ⁦`c`⁩' AS isolated FROM part""")
def markdown_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    lone = F.when(F.col("p_size") % 2 == 0, joined(" $x=", size, "$ ")).otherwise(joined("$y", size, "$"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", documents.equations_promoted(joined("a\n", lone, "\nb $z$")).alias("promoted"), T.spaced_superscripts(joined("n <sup>", size, "</sup>m")).alias("raised"),
        documents.centred_divs_unwrapped(joined('<div style="text-align: center;"> Note ', size, ' </div><div style="text-align:center;">(a)</div>')).alias("divs"), T.isolate_ltr(joined("$x", size, "$ and `c`")).alias("isolated"))


@query("""SELECT doc_id, CASE WHEN n = 1 THEN 'Smith ' || doc_id || ' 2001.' ELSE 'Two lines 2002' END AS text, n::INT AS number FROM documents, (SELECT unnest([1, 2]) AS n) WHERE text IS NOT NULL""")
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", joined("# T\n\n## References\n\n[1] Smith ", F.col("doc_id"), " 2001.\n[2] Two\nlines 2002\n\n## Next\n").alias("md"))
    return documents.references(docs, "doc_id", "md").select("doc_id", "text", "number")


@query("""SELECT page_id, r::INT AS "row", c::INT AS "column", CASE WHEN r = 0 AND c = 0 THEN 2 ELSE 1 END::INT AS row_span, CASE WHEN r = 0 AND c = 0 THEN 'h' || page_id ELSE 'x' || r || c END AS text FROM pages,
  (SELECT unnest([0, 0, 1]) AS r, unnest([0, 1, 1]) AS c)""")
def html_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = joined("<p>a</p><table><tr><th rowspan=2>h", F.col("page_id"), "</th><td>x01</td></tr><tr><td>x11</td></tr></table>")
    cells = documents.html_tables(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")
    return cells.select("page_id", "row", "column", "row_span", "text")


@query("""SELECT p_partkey, '<table><tr><th>' || p_brand || '</th><th>q</th></tr><tr><td>a&lt;b</td><td>' || p_size || '</td></tr></table>' AS html FROM part""")
def table_as_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = joined("|", F.col("p_brand"), "|q|\n|---|---|\n|a<b|", F.col("p_size"), "|")
    return table(spark, sf_dir, "part").select("p_partkey", documents.table_html(documents.pipe_table(md)).alias("html"))


# Layout ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS block, (l_partkey % 2) * 500.0 + 50 AS l, l_linenumber * 60.0 AS t, l_suppkey % 3 = 0 AS v FROM ({_LINES}))
SELECT page, block FROM b WHERE NOT v AND NOT EXISTS (SELECT 1 FROM b x WHERE x.v AND x.page = b.page AND b.l < x.l + 350 AND b.l + 350 > x.l AND b.t < x.t + 100 AND b.t + 100 > x.t)""")
def translatable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _boxes(spark, sf_dir).withColumn("top", F.col("top") / 2).withColumn("bottom", F.col("top") + 100)
    return layout.translatable(near).select("page", "block")


@query("""SELECT c_custkey, [792.0 - 40, 10, 792 - 20, 30 + c_custkey]::DOUBLE[] AS quarter, [612.0 - 30 - c_custkey, 792 - 40, 612 - 10, 792 - 20]::DOUBLE[] AS half, CASE WHEN c_nationkey > 0 AND c_nationkey * 0.5 <= c_nationkey % 13 THEN 'paper' ELSE 'book' END AS profile,
  c_custkey * 2 AS slot FROM customer""")
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array(F.lit(10.0), F.lit(20.0), F.col("c_custkey") + 30.0, F.lit(40.0))
    turned = lambda by: layout.rotated(layout.bbox(box), F.lit(612.0), F.lit(792.0), F.lit(by))
    return table(spark, sf_dir, "customer").select("c_custkey", turned(90).alias("quarter"), turned(180).alias("half"), layout.profile(F.col("c_nationkey") % 13, F.col("c_nationkey")).alias("profile"), reader.slot_of_page(F.col("c_custkey")).alias("slot"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) >= 12 THEN CASE WHEN turn % 2 = 0 THEN 5 WHEN strpos(substr(text, strpos(text, substr(text, 6, 7)) + 1), substr(text, 6, 7)) = 0 THEN strpos(text, substr(text, 6, 7)) - 1 END END AS start
FROM conversations WHERE text IS NOT NULL""")
def anchor_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    quote = F.when(F.length("text") >= 12, F.substring("text", 6, 7)).otherwise(F.lit(""))
    anchor = F.struct(F.when(F.col("turn") % 2 == 0, F.lit("now")).otherwise(F.lit("old")).alias("revision"), F.lit(5).alias("start"), F.lit(12).alias("end"), quote.alias("quote"), F.lit(None).cast("string").alias("prefix"), F.lit("").alias("suffix"))
    return c.select("conv_id", "turn", reader.resolved(F.col("text"), F.lit("now"), anchor)["start"].cast("bigint").alias("start"))
