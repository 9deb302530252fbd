"""Quality selection by importance resampling.

Two hashed n-gram models, one of target text (documents labelled good and not toxic) and one of the raw corpus (all
documents), give each document its importance weight: the sum over all its n-grams of log(target / raw), whichever its sign.
Gumbel top-k then draws k documents without replacement in proportion to their weights: the k largest of log weight plus
standard Gumbel noise.

N-grams: every word or run of punctuation, every two of them in a row, the first four, five and six bytes of longer words, and
a mark for a token that repeats the one before. Both models add SMOOTHING counts to each bucket, at the size of the target sample, so a bucket that
the sample can tell little about has a ratio near one. The weight is a sum, not a mean: a long document has more evidence on
either side and is weighed by all of it; nothing is divided by its length.

k is a parameter. Where it is not given, labels calibrate it: it is the number of documents whose weight reaches the value
that best separates a held-out part of the labelled documents. Labels never replace a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.tables import stored

#: log2 of the buckets that n-grams are hashed to, one half for pairs of tokens and one for the others: both models are 4 MB, however
#: large the corpus is.
BUCKET_BITS = 19
#: Labelled documents that the target model and the threshold are learned from, at most; every fourth is held out.
MAX_LABELLED = 50_000
PREFIXES = (4, 5, 6)
#: Text bytes whose n-grams are worked out at once.
PIECE_BYTES = 1 << 19
#: Counts that both models add to each bucket, in units of the target sample.
SMOOTHING = 5.0
#: How many lost good documents weigh as much as one kept bad one, when the threshold is chosen.
LOSS_WEIGHT = 2.0
_KIND = np.array([0 if b <= 0x20 or b == 0x7F else 1 if W.ALPHANUMERIC[W.LOWER[b]] else 2 for b in range(256)], np.uint8)
_REPEAT = W.mixed(np.array([7], np.uint64))[0]


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the text of every n-gram of the texts in one buffer."""
    data = W.LOWER[data]
    found = W.find(data, at, _KIND)
    owner = found.owner()
    token = W.span_hashes(data, found.start, found.end)
    hashes, texts = [token], [owner]
    for n in PREFIXES:
        long = found.end - found.start >= n
        hashes.append(W.mixed(W.span_hashes(data, found.start[long], found.start[long] + n) + np.uint64(n)))
        texts.append(owner[long])
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    again = inside[token[inside + 1] == token[inside]] + 1
    hashes.append(np.full(len(again), _REPEAT))
    texts.append(owner[again])
    half, shift = 1 << (BUCKET_BITS - 1), np.uint64(65 - BUCKET_BITS)
    pairs = (W.gram_hashes(token, 2)[inside] >> shift).astype(np.int64) + half
    return np.concatenate([(np.concatenate(hashes) >> shift).astype(np.int64), pairs]), np.concatenate([*texts, owner[inside]])


def _counted(batches):
    """Counts by bucket: of all texts, and of those whose row is marked as target."""
    raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        marked = batch.column(1).to_numpy(zero_copy_only=False)
        for row, end, data, at in W.pieces(batch.column(0), PIECE_BYTES):
            bucket, text = grams(data, at)
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[marked[row:end][text]], minlength=len(raw))
    full = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(raw[full]), pa.array(target[full])], ["bucket", "raw", "target"])


def _log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) of every bucket, both models smoothed; raw counts are scaled to the size of the target sample."""
    if not target.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def _weighted(batches, model, place: int | None):
    for batch in batches:
        texts = batch.column(1) if place is None else batch.column(0).field(place)
        for row, end, data, at in W.pieces(texts, PIECE_BYTES):
            bucket, text = grams(data, at)
            n = np.bincount(text, minlength=end - row)
            total = np.bincount(text, model.value[bucket], minlength=end - row)
            weight = pa.array(total, mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), weight], ["id", "weight"])


def weighted(rows: DataFrame, text: str, model, keep: list[str] | None = None) -> DataFrame:
    """Every row's columns keep (default: all) as struct id, with its log importance weight (null for a text without n-grams). A kept text
    is sent to the task's Python once, inside the struct."""
    keep = rows.columns if keep is None else keep
    place = keep.index(text) if text in keep else None
    base = rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("id"), *([F.col(text).alias("t")] if place is None else []))
    return base.mapInArrow(lambda it: _weighted(it, model, place), f"id {base.schema[0].dataType.simpleString()}, weight double")


def labelled_sample(labels: DataFrame, doc_id: str, quality: str, toxic: str) -> DataFrame:
    """At most MAX_LABELLED documents by a hash order, each once: doc, good, held_out. Labels without an id or quality are passed over."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("doc")).agg(
        ((F.min(quality) == 1) & (F.coalesce(F.max(toxic), F.lit(0)) == 0)).alias("good"))
    order = F.xxhash64("doc", F.lit("labels"))
    return known.orderBy(order).limit(MAX_LABELLED).select("doc", "good", (F.pmod(F.xxhash64("doc", F.lit("held out")), F.lit(4)) == 0).alias("held_out"))


def _threshold(held_out: DataFrame) -> float:
    """The weight that best separates good from other held-out documents (a row for each, at most MAX_LABELLED); rows that repeat an id count as
    one of their mean weight."""
    rows = held_out.select("weight", "good").toPandas()
    weight, good = rows["weight"].to_numpy(float), rows["good"].to_numpy(bool)
    if good.all() or not good.any():
        return -np.inf if good.any() or not len(good) else np.inf
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    lost, caught = np.cumsum(good) / good.sum(), np.cumsum(~good) / (~good).sum()
    ends = np.flatnonzero(np.append(np.diff(weight) > 0, True))[:-1]
    gain = caught[ends] - LOSS_WEIGHT * lost[ends]
    if not len(ends) or gain.max() <= 0:
        return -np.inf
    best = ends[np.argmax(gain)]
    return float((weight[best] + weight[best + 1]) / 2)


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest of a column of finite doubles, by counting in ever smaller bins; few values reach the driver."""
    rows = rows.select(F.col(column).alias("x")).filter("x IS NOT NULL")
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    while True:
        inside = rows.filter(F.col("x").between(low, high))
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            return high
        bins = inside.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(4095)).cast("int").alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(F.desc("b")).collect()
        for b in bins:
            if k <= b["n"]:
                break
            k -= b["n"]
        low, high = b["low"], b["high"]
        if b["n"] <= 10_000:
            return sorted((r[0] for r in rows.filter(F.col("x").between(low, high)).collect()), reverse=True)[k - 1]


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key alone, so that a task run again draws the same."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


class Selection:
    """A fitted selection: the model, k, and the smallest key that is kept."""

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", seed: int = 0,
                 k: int | None = None):
        spark = docs.sparkSession
        self.doc_id, self.text, self.seed = doc_id, text, seed
        sample = stored(labelled_sample(labels, doc_id, quality, toxic), "labelled")
        rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
        marked = rows.join(F.broadcast(sample), "doc", "left").select("t", (F.coalesce("good", F.lit(False)) & ~F.coalesce("held_out", F.lit(True))).alias("m"))
        counts = marked.mapInArrow(_counted, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # columns; rows would be objects on the driver
        raw, target = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
        bucket = counts["bucket"].to_numpy()
        raw[bucket], target[bucket] = counts["raw"].to_numpy(), counts["target"].to_numpy()
        self.model = spark.sparkContext.broadcast(_log_ratios(raw, target))
        scored = stored(weighted(rows, "t", self.model, ["doc"]).select("id.doc", "weight").withColumn("key", self._key("doc")), "weights")
        if k is None:
            held_out = scored.filter("weight IS NOT NULL").join(F.broadcast(sample.filter("held_out")), "doc")
            self.threshold = _threshold(held_out.groupBy("doc").agg(F.avg("weight").alias("weight"), F.first("good").alias("good")))
            k = scored.filter(F.col("weight") >= self.threshold).count()
        self.k = min(k, scored.filter("weight IS NOT NULL").count())
        self.cut = kth_largest(scored, "key", self.k) if self.k else np.inf
        self.scored = scored

    def _key(self, doc_id: str) -> Column:
        return F.col("weight") + gumbel(F.col(doc_id), self.seed)

    def scores(self) -> DataFrame:
        """doc_id, log_weight, key and kept per row."""
        return self.scored.select(F.col("doc").alias(self.doc_id), F.col("weight").alias("log_weight"), "key", F.coalesce(F.col("key") >= self.cut, F.lit(False)).alias("kept"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that the selection keeps, with all their columns."""
        return weighted(docs, self.text, self.model).withColumn("k", self._key(f"id.{self.doc_id}")).filter(F.col("k") >= self.cut).select("id.*")


def select(docs: DataFrame, labels: DataFrame, **options) -> Selection:
    """Fit on all rows of docs and a bounded sample of labels.

    k: how many documents to draw; by default as many as the held-out labels suggest. Null, empty and blank texts have no
    n-grams, no weight, and are not kept. Very long texts are weighed whole. Rows that repeat an id draw the same noise; ties
    with the k-th key are all kept. Labels of unknown documents are passed over; if none are left, or none is bad, every
    document with n-grams is kept. An empty table gives no rows. Other columns, whatever their names, go along untouched.
    """
    return Selection(docs, labels, **options)
