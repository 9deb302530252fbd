"""Queries over bibliographic records: identifiers, file names, duplicates, fuzzy titles, versions, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import linkage, metrics, search
from paperloom.plans.registry import query, table

_RAW = """CASE o_orderkey % 10 WHEN 0 THEN ' https://doi.org/10.1234/ab' || o_orderkey || 'c). ' WHEN 1 THEN 'doi: 10.55555/x' || o_orderkey || '.PDF'
  WHEN 2 THEN 'http://dx.doi.org/10.1000/y' || o_orderkey || '</b>' WHEN 3 THEN 'arXiv:2101.0' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || 'v2'
  WHEN 4 THEN 'https://arxiv.org/pdf/hep-th/9' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || '.pdf?x=1' WHEN 5 THEN 'PMID:' || o_orderkey
  WHEN 6 THEN 'ISBN: 978-0-306-' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || '-7' WHEN 7 THEN '10.12/short' || o_orderkey
  WHEN 8 THEN 'free text ' || o_orderkey ELSE lpad(o_orderkey::VARCHAR, 9, '0') || 'X' END"""
_RAW_SPARK = _RAW.replace("::VARCHAR", "").replace("(o_orderkey % 10000)", "cast(o_orderkey % 10000 AS string)").replace("(o_orderkey % 1000000)", "cast(o_orderkey % 1000000 AS string)").replace("(o_orderkey % 100000)", "cast(o_orderkey % 100000 AS string)").replace("lpad(o_orderkey,", "lpad(cast(o_orderkey AS string),")
_DOI = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(raw), '^(https?://(dx\.)?doi\.org/|doi:)', '', 'i')), '</[A-Za-z][^<>\s]*>$', ''), '\.pdf$', '', 'i'), '[.,;)\]]+$', '')"""


@query(rf"""WITH r AS (SELECT o_orderkey, {_RAW} AS raw FROM orders), d AS (SELECT o_orderkey, {_DOI} AS x FROM r)
SELECT o_orderkey, CASE WHEN regexp_full_match(x, '10\.\d{{4,}}/\S+') THEN x END AS doi FROM d""")
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RAW_SPARK).alias("raw"))
    return rows.select("o_orderkey", T.normalize_doi(F.col("raw")).alias("doi"))


@query(rf"""WITH r AS (SELECT o_orderkey, {_RAW} AS raw FROM orders), d AS (SELECT *, {_DOI} AS x,
  regexp_replace(regexp_replace(trim(regexp_replace(trim(raw), '^(https?://arxiv\.org/(abs|pdf)/|arxiv:)', '', 'i')), '[?#].*$', ''), '\.pdf$', '', 'i') AS a,
  trim(regexp_replace(trim(raw), '^(PMID:|pmid:|Pmid:)', '')) AS p, regexp_replace(trim(regexp_replace(trim(raw), '^(isbn-10:|isbn-13:|isbn:)', '', 'i')), '[-\s]', '', 'g') AS i FROM r),
k AS (SELECT *, CASE WHEN regexp_full_match(x, '10\.\d{{4,}}/\S+') THEN 'doi' WHEN regexp_full_match(a, '\d{{4}}\.\d{{4,5}}(v\d+)?') OR regexp_full_match(a, '[a-zA-Z][a-zA-Z0-9-]*(\.[a-zA-Z0-9-]+)?/\d{{7}}(v\d+)?') THEN 'arxiv'
  WHEN regexp_full_match(p, '\d{{1,8}}') THEN 'pmid' WHEN regexp_full_match(i, '\d{{9}}[\dXx]|\d{{13}}') THEN 'isbn' ELSE 'unknown' END AS type FROM d)
SELECT o_orderkey, type, CASE type WHEN 'doi' THEN x WHEN 'arxiv' THEN a WHEN 'pmid' THEN p WHEN 'isbn' THEN i ELSE trim(raw) END AS value FROM k""")
def identifier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RAW_SPARK).alias("raw"))
    return rows.select("o_orderkey", T.identifier(F.col("raw")).alias("i")).select("o_orderkey", "i.type", "i.value")


_NAME = """CASE p_partkey % 4 WHEN 0 THEN '2019-Smith-' || p_name || '.pdf' WHEN 1 THEN 'scan 2021-Jones-' || p_name || '-part two.PDF'
  WHEN 2 THEN p_name || ' 1998 notes.pdf' ELSE p_name || '.pdf' END"""


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '-part two' END AS title,
  CASE p_partkey % 4 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Jones' END AS author, CASE p_partkey % 4 WHEN 0 THEN '2019' WHEN 1 THEN '2021' WHEN 2 THEN '1998' END AS year FROM part""")
def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAME).alias("n"))
    return rows.select("p_partkey", T.filename_metadata(F.col("n")).alias("m")).select("p_partkey", "m.title", "m.author", "m.year")


_TITLES = """CASE p_partkey % 6 WHEN 0 THEN '/tmp/' || p_name WHEN 1 THEN p_name || '.EPS' WHEN 2 THEN 'Untitled-' || p_partkey WHEN 3 THEN 'Microsoft Word - Document' || p_partkey
  WHEN 4 THEN '  ' ELSE p_name END"""


@query("SELECT p_partkey, p_partkey % 6 = 5 AS plausible FROM part")
def plausible_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.is_plausible_title(F.expr(_TITLES)).alias("plausible"))


_DOCS = """SELECT {id} AS id, {title} AS title, {author} AS author, {year} AS year, {doi} AS doi FROM part WHERE p_partkey % 2 = {half}"""
_SIDE = {
    0: {"id": "p_partkey", "title": "'Title  ' || (p_partkey // 6)", "author": "'A' || (p_partkey % 5)", "year": "(1990 + p_partkey % 3)::VARCHAR", "doi": "CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || (p_partkey // 4) ELSE '' END", "half": "0"},
    1: {"id": "p_partkey", "title": "' tITLE ' || (p_partkey // 6)", "author": "'a' || (p_partkey % 5)", "year": "(1990 + p_partkey % 3)::VARCHAR", "doi": "CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || (p_partkey // 4) END", "half": "1"},
}
_KEYS = "SELECT id, nullif(lower(trim(doi)), '') AS d, nullif(regexp_replace(lower(trim(title)), '\\s+', ' ', 'g'), '') AS t, lower(author) AS a, year AS y FROM ({0})"


def _records(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    sql = {k: v.replace("::VARCHAR", "").replace("//", "div") for k, v in _SIDE[half].items()}
    rows = table(spark, sf_dir, "part").filter(f"p_partkey % 2 = {half}")
    return rows.select(F.expr(sql["id"]).cast("string").alias("id"), F.expr(sql["title"]).alias("title"), F.array(F.expr(sql["author"])).alias("authors"),
                       F.expr(f"cast({sql['year']} AS string)").alias("year"), F.expr(sql["doi"]).alias("doi"))


@query(f"""WITH e AS ({_KEYS.format(_DOCS.format(**_SIDE[0]))}), i AS ({_KEYS.format(_DOCS.format(**_SIDE[1]))}),
p AS (SELECT i.id::VARCHAR AS id, e.id::VARCHAR AS other, CASE WHEN i.d = e.d THEN 0 ELSE 1 END AS k FROM i JOIN e ON
  (i.d IS NOT NULL AND e.d IS NOT NULL AND i.d = e.d) OR ((i.d IS NULL OR e.d IS NULL) AND i.t = e.t AND (i.y = e.y OR i.a = e.a)))
SELECT id, min((k, other))[2] AS duplicate_of FROM p GROUP BY id""")
def title_key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.duplicates(_records(spark, sf_dir, 0), _records(spark, sf_dir, 1))


@query(f"""WITH e AS ({_KEYS.format(_DOCS.format(**_SIDE[0]))}), b AS ({_KEYS.format(_DOCS.format(**_SIDE[1]))}),
p AS (SELECT b.id::VARCHAR AS old, 1 AS k, e.id::VARCHAR AS new FROM b JOIN e ON b.d = e.d UNION ALL
  SELECT b.id::VARCHAR, 2, e.id::VARCHAR FROM b JOIN e ON b.t = e.t AND (b.y = e.y OR b.a = e.a) UNION ALL SELECT id::VARCHAR, 3, id::VARCHAR FROM b)
SELECT old, min((k, new))[2] AS new, CASE min((k, new))[1] WHEN 1 THEN 'doi' WHEN 2 THEN 'title' ELSE 'added' END AS how FROM p GROUP BY old""")
def backup_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.backup_id_map(_records(spark, sf_dir, 0), _records(spark, sf_dir, 1))


_FOLD_ROWS = f"SELECT row_number() OVER (ORDER BY id) AS n, id::VARCHAR AS id, d, t, y, a FROM ({_KEYS.format(_DOCS.format(**_SIDE[0]))} UNION ALL {_KEYS.format(_DOCS.format(**_SIDE[1]))})"


# One step a record: the records accepted so far are a list that the next one is looked up in.
@query(f"""WITH RECURSIVE r AS ({_FOLD_ROWS}), f AS (
  SELECT 0::BIGINT AS n, NULL::VARCHAR AS id, NULL::VARCHAR AS hit, []::STRUCT(id VARCHAR, d VARCHAR, t VARCHAR, y VARCHAR, a VARCHAR)[] AS kept
  UNION ALL SELECT n, id, hit, CASE WHEN hit IS NULL THEN list_append(kept, struct_pack(id := id, d := d, t := t, y := y, a := a)) ELSE kept END FROM (
    SELECT r.n, r.id, r.d, r.t, r.y, r.a, f.kept, coalesce(list_filter(f.kept, lambda k: k.d = r.d)[1].id,
      list_filter(f.kept, lambda k: k.t = r.t AND (k.d IS NULL OR r.d IS NULL) AND coalesce(k.y = r.y OR k.a = r.a, k.y = r.y, k.a = r.a, false))[1].id) AS hit FROM f JOIN r ON r.n = f.n + 1))
SELECT id, hit IS NULL AS accepted, coalesce(hit, id) AS target FROM f WHERE n > 0""")
def import_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir, 0).union(_records(spark, sf_dir, 1)).withColumn("ordinal", F.col("id").cast("long"))
    return linkage.fold_import(rows)


_GRAMS = "SELECT key, t, length(t) - 1 AS total, g, count(*) AS n FROM (SELECT key, t, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM ({0})) GROUP BY ALL"
_FORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH a AS ({_GRAMS.format("SELECT p_partkey AS key, " + _FORM.format("p_name || ' ' || p_brand") + " AS t FROM part WHERE p_partkey % 50 = 0")}),
b AS ({_GRAMS.format("SELECT p_partkey AS key, " + _FORM.format("p_name") + " AS t FROM part")}),
s AS (SELECT a.key AS query, b.key AS match, round(2 * sum(least(a.n, b.n)) / (a.total + b.total), 9) AS score FROM a JOIN b ON a.g = b.g GROUP BY a.key, b.key, a.total, b.total)
SELECT query, min((-score, match))[2] AS match, max(score) AS score FROM s WHERE score >= 0.55 GROUP BY query""")
def dice_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    wanted = parts.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    out = linkage.best_matches(wanted, parts.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title")))
    return out.withColumn("score", F.round("score", 9))


@query("SELECT p_partkey, (p_partkey % 3) || '.' || (p_partkey % 12) AS v, CASE WHEN p_partkey % 3 > 1 OR (p_partkey % 3 = 1 AND p_partkey % 12 > 2) THEN 1 WHEN p_partkey % 3 = 1 AND p_partkey % 12 = 2 THEN 0 ELSE -1 END AS against FROM part")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat_ws(".", F.col("p_partkey") % 3, F.col("p_partkey") % 12)
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v"), T.compare_versions(v, F.lit("1.2.0")).alias("against"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%tion the%' OR source ILIKE '%tion the%' OR lang ILIKE '%tion the%'")
def search_any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.like(table(spark, sf_dir, "documents"), "tion the", ("text", "source", "lang")).select("doc_id")


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text || ' ' || source), '[a-z0-9]+')) AS w FROM documents)
SELECT doc_id AS id FROM t WHERE list_contains(w, 'with') AND list_contains(w, 'that') AND list_contains(w, 'from')""")
def search_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match(search.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "That with FROM")


@query("""WITH f AS (SELECT DISTINCT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'from')), l AS (SELECT doc_id FROM documents WHERE text ILIKE '%from%')
SELECT doc_id AS id, min(phase)::INT AS phase FROM (SELECT doc_id, 0 AS phase FROM f UNION ALL SELECT doc_id, 1 FROM l) GROUP BY doc_id""")
def search_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = search.match(search.inverted_index(docs, "doc_id", "text"), "from")
    return search.merged(found, search.like(docs, "from", ("text",)).select(F.col("doc_id").alias("id")))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR (doc_id % 7 = 0 AND lang IS DISTINCT FROM 'xx')")
def index_stale_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    index = docs.filter("doc_id % 10 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, F.lit("xx")).otherwise(F.col("lang")))
    return search.stale(index, docs, "doc_id", "lang", "source")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id)::INT AS occurrence, count(*) OVER (PARTITION BY text)::BIGINT AS n_equal FROM documents""")
def occurrence_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("print"))
    return metrics.occurrences(rows, ["print"], ["doc_id"]).drop("print")


@query("SELECT c_custkey, c_name || ' ' || c_mktsegment AS name, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::INT AS authors FROM customer")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit(" ... "), F.col("c_mktsegment"))).otherwise(F.concat(F.lit(" , "), F.col("c_name")))
    return c.select("c_custkey", T.person_name(F.concat(F.lit("  "), "c_name"), F.col("c_mktsegment")).alias("name"), F.size(T.author_line(line)).alias("authors"))
