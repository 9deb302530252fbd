"""Search over a library: inverted index, substring search, and their ordered union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
HAN_RUN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]+"


def tokens(text: Column) -> Column:
    """Distinct lower-case words, and bigrams of Han runs (a run of one is its own token)."""
    lower = F.lower(text)
    runs = F.regexp_extract_all(lower, F.lit(HAN_RUN), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(F.regexp_extract_all(lower, F.lit(TOKEN), F.lit(0)), grams))


def inverted_index(docs: DataFrame, key: str, *fields: str) -> DataFrame:
    """(token, id) of the fields together, each once."""
    return docs.select(F.explode(tokens(F.concat_ws(" ", *fields))).alias("token"), F.col(key).alias("id"))


def match(index: DataFrame, query: str) -> DataFrame:
    """Ids that have every token of the query. The token filter reaches the scan of a stored index."""
    wanted = index.sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]
    if not wanted:
        return index.select("id").limit(0)
    return index.filter(F.col("token").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def stale(index: DataFrame, docs: DataFrame, key: str, *fields: str) -> DataFrame:
    """Documents whose indexed fields (index: one row a document) differ from the stored ones, nulls being equal, or are missing."""
    i = index.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    changed = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields], F.col("_k").isNull())
    return docs.join(i, F.col(key) == F.col("_k"), "left").filter(changed).select(key)


def like(docs: DataFrame, query: str, fields: tuple[str, ...], escape_wildcards: bool = False) -> DataFrame:
    """Rows with the query in any field, letters folded. Wildcards in the query stay wildcards unless escaped."""
    pattern = query
    if escape_wildcards:
        pattern = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return docs.filter(reduce(lambda a, b: a | b, [F.col(f).ilike(f"%{pattern}%") for f in fields]))


def any_field(query: str, texts: tuple[str, ...], lists: tuple[str, ...] = ()) -> Column:
    """Whether a field, or an element of a list, contains the query; an empty query is in all."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    found = [F.coalesce(F.contains(F.lower(F.col(t)), F.lit(q)), F.lit(False)) for t in texts]
    found += [F.coalesce(F.exists(x, lambda v: F.contains(F.lower(v), F.lit(q))), F.lit(False)) for x in lists]
    return reduce(lambda a, b: a | b, found)


def merged(*hits: DataFrame) -> DataFrame:
    """Hits (id) of several searches in order, each id once with the first search that found it: id, phase."""
    parts = [h.select("id", F.lit(n).alias("phase")) for n, h in enumerate(hits)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min("phase").alias("phase"))
