"""What a reader needs of paragraphs: anchors, quotes, translations beside their source, and fuzzy places."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from paperloom.functions import text as T
from paperloom.functions.places import cutting, let, placed


def places(text: Column, quote: Column) -> Column:
    """Starts (from 0) of all occurrences of quote, overlapping ones too; none of an empty quote."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    # A match is the first letter alone, with the others ahead of it, so matches may overlap.
    pattern = F.concat(quoted(F.substring(quote, 1, 1)), F.lit("(?="), quoted(F.substr(quote, F.lit(2))), F.lit(")"))
    at = F.transform(placed(text, pattern), lambda p: p["start"])
    return F.when((F.length(quote) > 0) & F.contains(text, quote), at).otherwise(F.array().cast("array<int>"))


def resolved(text: Column, revision: Column, anchor: Column) -> Column:
    """struct(start, end) of an anchor (revision, start, end, quote, prefix, suffix) in a text: where it was if the text has not
    changed, else the one place with the quote between its prefix and suffix; null if there is none or several."""
    q, n = anchor["quote"], F.length(anchor["quote"])
    kept = (anchor["revision"] == revision) & (anchor["start"] >= 0) & (anchor["end"] > anchor["start"]) & (F.substr(text, anchor["start"] + 1, anchor["end"] - anchor["start"]) == q)
    prefix, suffix = F.coalesce(anchor["prefix"], F.lit("")), F.coalesce(anchor["suffix"], F.lit(""))

    def one(found: Column) -> Column:
        return F.when(F.size(found) == 1, F.struct(F.get(found, F.lit(0)).alias("start"), (F.get(found, F.lit(0)) + n).alias("end")))

    def fitting(cut: Callable[[Column, Column], Column]) -> Column:
        before, behind = F.length(prefix), F.length(suffix)
        return F.filter(places(text, q), lambda i: F.when(i >= before, (cut(i - before, i) == prefix) & (cut(i + n, i + n + behind) == suffix)).otherwise(False))

    moved = let(cutting(text, fitting), one)
    return F.when(kept, F.struct(anchor["start"].alias("start"), anchor["end"].alias("end"))).otherwise(moved)


def restored(highlights: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, paragraph, start, end) of highlights (id, doc, quote, prefix, suffix) whose quote, white space collapsed, stands in
    exactly one paragraph (doc, paragraph, text) of their document, and once in it, between prefix and suffix."""
    h = highlights.select("id", "doc", T.collapse(F.col("quote")).alias("q"), F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    joined = h.filter("q <> ''").join(paragraphs, "doc").filter(F.contains("text", "q"))
    joined = joined.withColumn("at", places(F.col("text"), F.col("q"))).filter(F.size("at") == 1).withColumn("start", F.get("at", F.lit(0)))
    fits = F.endswith(F.substr(F.col("text"), F.lit(1), F.col("start")), F.col("prefix")) & F.startswith(F.substr(F.col("text"), F.col("start") + F.length("q") + 1, F.length("text")), F.col("suffix"))
    one = joined.filter(fits).groupBy("id").agg(F.count("*").alias("n"), F.first("paragraph").alias("paragraph"), F.first("start").alias("start"), F.first(F.col("start") + F.length("q")).alias("end"))
    return one.filter("n = 1").drop("n")


def paragraph_of_quote(quotes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, paragraph): the one paragraph that holds the quote, white space and soft hyphens aside."""
    def key(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)[\s\x{00AD}\x{200B}]+", "")

    q = quotes.select("id", "doc", key(F.col("quote")).alias("q")).filter("q <> ''")
    p = paragraphs.select("doc", "paragraph", key(F.col("text")).alias("k"))
    return q.join(p, "doc").filter(F.contains("k", "q")).groupBy("id").agg(F.count("*").alias("n"), F.first("paragraph").alias("paragraph")).filter("n = 1").drop("n")


def paired(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two numbered sides (see metrics.occurrences) with equal key and number, where both sides have as many of the key."""
    r = right.select(*key, "occurrence", "n_equal", F.col("place").alias("other"))
    return left.join(r, [*key, "occurrence", "n_equal"])


def with_translations(paragraphs: DataFrame, cache: DataFrame, show_source: bool = True, show_translation: bool = True) -> DataFrame:
    """Paragraphs (hash, text) with their translation (hash, translation) if cached: columns source, translated, pending."""
    joined = paragraphs.join(cache.select("hash", F.nullif(T.strip(F.col("translation")), F.lit("")).alias("translated")), "hash", "left")
    source = F.when(F.lit(show_source) | (F.lit(show_translation) & F.col("translated").isNull()), F.col("text"))
    return joined.withColumn("pending", F.col("translated").isNull()).withColumn("source", source).withColumn("translated", F.when(F.lit(show_translation), F.col("translated")))


def _fuzzy_place(text: str, needle: str, threshold: float) -> int:
    n, best, at = len(needle), 0.0, -1
    wanted = Counter(needle[i : i + 2] for i in range(n - 1))
    for i in range(max(0, min(len(text), n * 6) - n + 1) if n >= 2 else 0):
        window = text[i : i + n]
        common = (wanted & Counter(window[k : k + 2] for k in range(n - 1))).total()
        score = 1.0 if window == needle else common / (n - 1)
        if score > best:
            best, at = score, i
    return at if best >= threshold else -1


def fuzzy_place(text: Column, needle: Column, threshold: float = 0.7) -> Column:
    """The start (from 0) of the window most like the needle (Dice coefficient of bigram multisets) in the first six needles'
    length of a text, the first of equals; -1 below the threshold or for a null."""
    @F.pandas_udf(IntegerType())
    def place(texts: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([_fuzzy_place(t or "", n or "", threshold) for t, n in zip(texts, needles, strict=True)])

    return place(text, needle)


def first_known(rows: DataFrame, candidates: str, known: DataFrame) -> DataFrame:
    """Each row (id, an array of candidate keys) with the value (key, value) of the first candidate that is known."""
    exploded = rows.select("id", F.posexplode(candidates).alias("pos", "key"))
    return exploded.join(known, "key").groupBy("id").agg(F.min_by("value", "pos").alias("value"))


def slot_of_page(page: Column) -> Column:
    """A page's slot where every page is followed by its translation."""
    return page * 2


def page_of_slot(slot: Column) -> Column:
    return F.floor(slot / 2).cast("int")
