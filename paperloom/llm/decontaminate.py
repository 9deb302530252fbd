"""Benchmark decontamination by winnowing.

Of every run of WINDOW - GRAM + 1 word grams in a row (the grams of a window of WINDOW words) the smallest hash is a
fingerprint, the rightmost of equals. Two texts that share a window share its fingerprint, so joining test and training
fingerprints finds every shared span of WINDOW words or more. A hit is extended to both sides, to the windows around the
fingerprint, and counts where a whole window agrees, word for word. Items shorter than a window are one gram of their own
length.

Fingerprints are joined together with the window that they are extended to, so a gram that very many items and documents
have brings together only those that share a window as well. Two bitmaps, sized by the benchmark, of its fingerprints and of
its windows keep others from leaving their task; a larger benchmark than they hold merely lets more through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.bitmaps import bitmap, contains
from paperloom.llm.tables import stored

WINDOW, GRAM = 10, 5
#: The most contaminated documents whose keys are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
_PRINT = pa.list_(pa.struct([("m", pa.int32()), ("gram", pa.int64()), ("hash", pa.int64()), ("start", pa.int32()), ("words", pa.string())]))


def _selected(gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the winnowed grams: of each window that lies in one text, the rightmost smallest."""
    n = WINDOW - GRAM + 1
    size = len(gram) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    low, place = gram[:size].copy(), np.zeros(size, np.int64)
    for k in range(1, n):
        better = gram[k : k + size] <= low
        low = np.where(better, gram[k : k + size], low)
        place[better] = k
    whole = owner[:size] == owner[WINDOW - 1 : WINDOW - 1 + size]
    return np.unique((place + np.arange(size))[whole])


def _windows(places: np.ndarray, m: int, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of m words around each fingerprint's place, inside its text: places in the list, first words."""
    side = WINDOW - GRAM if m == WINDOW else 0
    which = np.repeat(np.arange(len(places)), side + 1)
    start = places[which] - np.tile(np.arange(side + 1), len(places))
    inside = (start >= first[which]) & (start + m <= end[which])
    return which[inside], start[inside]


def _prints(batches, lengths: list[int], bitmaps):
    """Rows of (id, n_words, prints): each fingerprint with each window around it. bitmaps: None if each text is an item, of which
    only its own windows count."""
    for batch in batches:
        for row, end, data, at in W.pieces(batch.column(1)):
            data = W.LOWER[data]
            found = W.find(data, at, W.ALPHANUMERIC)
            count, owner = found.counts(), found.owner()
            word = W.span_hashes(data, found.start, found.end)
            columns = [[np.zeros(0, kind)] for kind in (*[np.int64] * 5, object)]
            for m in lengths:
                k = GRAM if m == WINDOW else m
                gram, whole = W.gram_hashes(word, k), W.gram_hashes(word, m)
                if m == WINDOW:
                    places = _selected(gram, owner)
                else:
                    places = np.flatnonzero(owner[: len(gram)] == owner[k - 1 :]) if len(gram) else np.zeros(0, np.int64)
                if bitmaps is None:
                    places = places[np.minimum(count, WINDOW)[owner[places]] == m]
                else:
                    places = places[contains(bitmaps[m][0], gram[places])]
                which, start = _windows(places, m, found.first[:-1][owner[places]], found.first[1:][owner[places]])
                if bitmaps is not None:
                    known = contains(bitmaps[m][1], whole[start])
                    which, start = which[known], start[known]
                text = owner[start]
                spans = zip(start.tolist(), (start + m).tolist(), strict=True)
                words = [b" ".join(data[a:b].tobytes() for a, b in zip(found.start[x:y].tolist(), found.end[x:y].tolist(), strict=True)).decode() for x, y in spans]
                for column, values in zip(columns, (text, np.full(len(text), m), gram[places][which].view(np.int64), whole[start].view(np.int64), start - found.first[text], words), strict=True):
                    column.append(np.asarray(values, object if values is words else None))
            text, *fields = (np.concatenate(c) for c in columns)
            order = np.argsort(text.astype(np.int64), kind="stable")
            struct = pa.StructArray.from_arrays([pa.array(f[order], t.type) for f, t in zip(fields, _PRINT.value_type, strict=True)], [t.name for t in _PRINT.value_type])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order].astype(np.int64), np.arange(end - row + 1)).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(count.astype(np.int64)), lists], ["id", "n_words", "prints"])


def _printed(df: DataFrame, lengths: list[int], bitmaps=None) -> DataFrame:
    kind = df.schema[0].dataType.simpleString()
    prints = "array<struct<m: int, gram: bigint, hash: bigint, start: int, words: string>>"
    return df.mapInArrow(lambda it: _prints(it, lengths, bitmaps.value if bitmaps else None), f"id {kind}, n_words bigint, prints {prints}")


def _printed_and_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored rows (row, doc, text_key, n_words), their hits (row, window, start, end), and the items of each window."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("t")).filter(F.col("item").isNotNull())
    of_items = stored(_printed(items, list(range(1, WINDOW + 1))).select("id", F.explode("prints").alias("p")).select(F.col("id").alias("item"), "p.*"), "items")
    lengths = sorted(r[0] for r in of_items.select("m").distinct().collect())  # ten at most
    bitmaps = {m: tuple(bitmap(of_items.filter(F.col("m") == m).select(F.col(c).alias("hash")).distinct()) for c in ("gram", "hash")) for m in lengths}
    bitmaps = spark.sparkContext.broadcast(bitmaps)

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    printed = _printed(base.select(F.struct("row", "doc", F.xxhash64("t").alias("text_key")).alias("id"), "t"), lengths, bitmaps)
    rows = stored(printed.select("id.row", "id.doc", "id.text_key", "n_words", "prints"), "prints")

    window = F.xxhash64("m", "words")  # names a window among those of the benchmark; the words themselves decide the join
    windows = of_items.select("m", "gram", "hash", "words", window.alias("window")).distinct()
    members = of_items.select(window.alias("window"), "words", "item").distinct()
    hits = (rows.filter(F.size("prints") > 0).select("row", F.explode("prints").alias("p")).select("row", "p.*")
            .join(windows, ["m", "gram", "hash", "words"])
            .select("row", "window", "words", "start", (F.col("start") + F.col("m")).alias("end")).distinct())
    return rows.drop("prints"), stored(hits, "hits"), members


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, item_ids (sorted strings), and spans of words that a benchmark window covers.

    Null and wordless texts have no words; items without an id or words have no windows; rows with equal ids stay rows of
    their own; repeated items count once. Very long texts are read whole. Empty tables give no rows, or rows without hits.
    Other columns are ignored, whatever their names.
    """
    rows, hits, members = _printed_and_hits(docs, benchmark, doc_id, text, item_id, item_text)
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    found = (hits.select("row", "window", "words").distinct().join(members, ["window", "words"]).select("row", "item").distinct()
             .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("item_ids")))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")))["n"]
    return (rows.select("row", "doc", "n_words").join(spans, "row", "left").join(found, "row", "left")
            .select(F.col("doc").alias(doc_id), "n_words", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark window occurs, all columns kept, whatever their names. Null and wordless texts stay,
    rows that repeat stay or go together; an empty benchmark leaves all rows, an empty table gives none."""
    rows, hits, _ = _printed_and_hits(docs, benchmark, doc_id, text, item_id, item_text)
    hit = stored(rows.join(hits.select("row").distinct(), "row", "left_semi").select(F.col("doc").alias("hit_doc"), F.col("text_key").alias("hit_text")).distinct(), "contaminated")
    hit = F.broadcast(hit) if hit.count() <= MAX_BROADCAST else hit
    original = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("original"))  # one column, so that no name clashes
    same = F.col(f"original.`{doc_id}`").eqNullSafe(F.col("hit_doc")) & (F.xxhash64(F.col(f"original.`{text}`")) == F.col("hit_text"))
    return original.join(hit, same, "left_anti").select("original.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT r, p, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
