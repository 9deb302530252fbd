"""Filter interaction audit: what every filter removes in every order, from one pass over the documents.

Each document gets a mask of the filters that it fails, and documents are counted by part and mask. The subset-zeta transform
adds those counts up over the subsets of each mask, one filter at a time, so that the entry of a set of filters' complement is
the number of documents that survive the set. A step of an order then is the difference of two neighbouring sets, whatever
came before; so are the labelled documents it loses, and a filter's Shapley sum weighs its differences over all sets.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.tables import stored

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 100, 80, 10
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", "[#$%&*|]"
FILTERS = "ABCDE"
#: The filter that compares documents with each other; the others look at one text.
REPEATED = "E"
MEASURES = ("n", "good", "toxic")


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, digest) of every row: bit i of mask is set if the row fails filter i of those that look at one text."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), content.alias("t"),
                       F.filter(F.split(content, BLANKS), lambda w: w != "").alias("words"))
    measured = rows.select("doc_id", "part", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
                           F.regexp_count("t", F.lit("[A-Z]")).alias("n_upper"), F.length("t").alias("n_chars"), F.col("t").rlike(SYMBOLS).alias("symbols"),
                           F.unhex(F.sha2("t", 256)).alias("digest"))
    n = lambda name: F.col(name).cast("long")  # noqa: E731  a hundred times a long text's count is past an int
    fails = (n("n_words") < MIN_WORDS, 100 * n("n_distinct") < MIN_DISTINCT_PERCENT * n("n_words"), 100 * n("n_upper") > MAX_UPPER_PERCENT * n("n_chars"), F.col("symbols"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return measured.select("doc_id", "part", mask.alias("mask"), "digest")


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail, those labelled good, and those labelled toxic.

    Texts are read once. The first document of each text and the labels are joined on ids (with the digest, for the first), so
    a text that a third of all documents repeat is no hot key; rows that repeat a document are one group before the joins.
    """
    rows = stored(marked(docs, doc_id, text, part), "marked")
    groups = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    named, nameless = groups.filter("doc_id IS NOT NULL"), groups.filter("doc_id IS NULL")
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"),
                                                                     F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    joined = named.join(first, ["doc_id", "digest"], "left").join(told, "doc_id", "left")
    again = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index(REPEATED))
    joined = joined.select("part", (F.col("mask") + again).alias("mask"), "n", "is_good", "is_toxic").unionByName(
        nameless.select("part", "mask", "n", F.lit(False).alias("is_good"), F.lit(False).alias("is_toxic")))
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
                                              F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def zeta(counts: Column, filters: int) -> Column:
    """Of an array of 2 ** filters counts by mask: the sums over all subsets of each mask, by one step a filter."""
    def step(now: Column, bit: Column) -> Column:
        return F.transform(now, lambda x, mask: x + F.when(mask.bitwiseAND(bit) != 0, F.get(now, mask - bit)).otherwise(F.lit(0)))

    return F.aggregate(F.array(*(F.lit(1 << i) for i in range(filters))), counts, step)


def audit(counts: DataFrame, filters: str = FILTERS, orders: list[str] | None = None) -> DataFrame:
    """The steps of every order, from rows (part, mask, n, good, toxic): part, filter_order, step, and the documents kept, removed,
    redundant (failing, but removed earlier), unique_fails (failing this filter only), good_lost, toxic_lost, and shapley.

    filters: one letter each, in the order of the mask's bits. orders: all permutations by default, for up to eight filters or so;
    shapley is over all of them in any case. An empty table gives no rows; masks that don't occur count as zero.
    """
    k, full = len(filters), (1 << len(filters)) - 1
    orders = ["".join(p) for p in permutations(filters)] if orders is None else orders
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("m"))
    dense = lambda name: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(0).cast("long")))
    sums = by_part.select("part", *(zeta(dense(name), k).alias(name) for name in MEASURES))

    def survivors(measure: str, gone: Column) -> Column:
        return F.get(F.col(measure), F.lit(full) - gone)

    orderings = F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)))

    def share(bit: int) -> Column:
        def add(total: Column, gone: Column) -> Column:
            lost = survivors("n", gone) - survivors("n", gone + F.lit(bit))
            return total + F.when(gone.bitwiseAND(F.lit(bit)) == 0, F.get(orderings, F.bit_count(gone).cast("int")) * lost).otherwise(F.lit(0))

        return F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), add)

    shares = sums.withColumn("shares", F.array(*(share(1 << i) for i in range(k))))
    steps = shares.withColumn("filter_order", F.explode(F.array(*(F.lit(o) for o in orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.length("filter_order"))))
    place = [F.instr(F.col("filter_order"), letter) for letter in filters]
    own = sum((F.when(p == F.col("step"), i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    before = sum((F.when((p > 0) & (p < F.col("step")), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    steps = steps.withColumn("own", own).withColumn("bit", F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), F.col("own") + 1)).withColumn("gone", before)
    lost = lambda m: survivors(m, F.col("gone")) - survivors(m, F.col("gone") + F.col("bit"))
    fails = survivors("n", F.lit(0)) - survivors("n", F.col("bit"))
    return steps.select("part", "filter_order", "step", survivors("n", F.col("gone") + F.col("bit")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
                        (survivors("n", F.lit(full) - F.col("bit")) - survivors("n", F.lit(full))).alias("unique_fails"), lost("good").alias("good_lost"),
                        lost("toxic").alias("toxic_lost"), F.get("shares", F.col("own")).alias("shapley"))


def interactions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """`audit` of the five filters over whole texts.

    A null text is the empty one, a null part the empty string. Repeated rows count each; a row without an id repeats nothing and
    has no label; several rows that share the smallest id of a text all come first. A document is good or toxic if any row of
    labels says so. Other columns are ignored, whatever their names; very long texts are read whole; without documents there are
    no parts and no rows.
    """
    return audit(mask_counts(docs, labels, doc_id, text, part))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(first < w.doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
k AS (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT p1.f || p2.f || p3.f || p4.f || p5.f AS o FROM f p1 JOIN f p2 ON p2.f <> p1.f JOIN f p3 ON p3.f NOT IN (p1.f, p2.f)
  JOIN f p4 ON p4.f NOT IN (p1.f, p2.f, p3.f) JOIN f p5 ON p5.f NOT IN (p1.f, p2.f, p3.f, p4.f)),
g AS (SELECT k.*, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
  || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM k),
s AS (SELECT o, unnest(range(1, 6))::INT AS step FROM o),
q AS (SELECT o, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS earlier FROM s),
r AS (SELECT part, o, step, f, n, good, toxic, fails, contains(fails, f) AS hit,
  length(translate(earlier, fails, '')) < length(earlier) AS gone FROM q, g),
x AS (SELECT part, o AS filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM x
"""
