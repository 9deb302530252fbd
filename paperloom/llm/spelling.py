"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie.

The words of a corpus form a trie. At every node one child is heavy, the one with the most words; the others are light, and so
is the end of a word. Two words one edit apart part ways at one node, and at least one of them leaves it by a light child. So
only light words are looked up elsewhere, with that character skipped or replaced: a word is light at no more nodes than the
logarithm of the number of words, because each light child holds at most half of its parent's. Merging small subtrees into
large ones this way, two words whose remainders coincide are a pair, and each pair is found once, at its node:

* replaced: light words that agree but for the character meet in a group; and each is looked up with the heavy character;
* skipped: a light word is looked up without the character (unless the next one is the same: then a deeper node finds it);
* inserted: a light word is looked up with the heavy character before it (a longer light word finds it from the other side).

Words and prefixes are compared by polynomial hashes, which an edit changes in one step, and every pair is verified on the
words. A node is a row, not a structure in memory: no task holds a trie, and a node of very many words is joined apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.tables import forget, stored

RUN = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Of so many (document, word) pairs, one loses a character.
DROP = 31
#: At most so many nodes are broadcast: those with more than a 1/HOT_NODES of all rows of nodes.
HOT_NODES = 50_000
#: Characters of words that a task works on at once.
PIECE_CHARS = 1 << 18
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_R_INVERSE = pow(_R, -1, 1 << 64)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NODES = "node bigint, depth int, c int, id bigint, again boolean"


def _lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else: quickly where no other letter could change, by table where one could."""
    plain = ~text.rlike(r"[^\x00-\x7Fß-ÿ]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts, with the planted deletions, that are long and frequent enough. Shorter runs never count,
    so they are not even cut out."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(_lowered(F.col(text)), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("key", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    found = runs.select(F.when(h % DROP == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


# The trie -------------------------------------------------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, r, np.uint64))]) for r in (_R, _R_INVERSE))


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each starts (and the last ends)."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _hashes(data: np.ndarray, at: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The hash of each prefix of each text, the empty and the whole one too: the sum of c * R ** place, from the text's start."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[: len(data)])])
    sizes = np.diff(at) + 1
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[:-1], sizes)
    begin = np.repeat(at[:-1], sizes)
    return (sums[place] - sums[begin]) * inverse[begin]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    for batch in batches:
        held, n = [], 0
        for text in batch.column(0).to_pylist():
            held.append(text)
            n += len(text)
            if n >= PIECE_CHARS:
                yield held
                held, n = [], 0
        if held:
            yield held


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word and each node on its way: the node (hash of the prefix, and its depth), the next character c (0: the word
    ends), the word's hash, and whether the character after the next is the same. What edits make of a word's hash follows from these."""
    names = [f.split()[0] for f in _NODES.split(", ")]
    for texts in _pieces(batches):
        data, at = _chars(texts)
        power, inverse = _powers(len(data) + 1)
        hashes = _hashes(data, at, power, inverse)
        sizes = np.diff(at) + 1
        ends = np.cumsum(sizes)
        depth = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        last = np.zeros(ends[-1], bool)
        last[ends - 1] = True
        c = np.zeros(ends[-1], np.int32)
        c[~last] = data.astype(np.int32) + 1
        again = np.append(c[1:] == c[:-1], False) & ~last
        columns = [hashes.view(np.int64), depth.astype(np.int32), c, np.repeat(hashes[ends - 1], sizes).view(np.int64), again]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word, n)."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        if texts:
            data, at = _chars(texts)
            power, inverse = _powers(len(data) + 1)
            ends = np.cumsum(np.diff(at) + 1)
            ids = _hashes(data, at, power, inverse)[ends - 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), batch.column(0), batch.column(1)], ["id", "word", "n"])


def light_rows(vocabulary: DataFrame) -> DataFrame:
    """The rows of `_nodes` at which a word is light, with the node's heavy character (0: the end of a word).

    Only nodes where words part have light children. Heavy children are found by counts (combined before the shuffle). Nodes with
    more than 1/HOT_NODES of all rows are at most HOT_NODES and broadcast; the words of any other are few enough for a join.
    """
    rows = vocabulary.select("word").mapInArrow(_nodes, _NODES)
    ways = rows.groupBy("node", "depth", "c").agg(F.count("*").alias("n"))
    heavy = ways.groupBy("node", "depth").agg(F.max_by("c", F.struct("n", "c")).alias("heavy"), F.count("*").alias("ways"), F.sum("n").alias("n"))
    heavy = stored(heavy.filter("ways > 1").select("node", "depth", "heavy", "n"), "heavy")
    total = heavy.agg(F.sum("n")).first()[0] or 0
    hot = heavy.filter(F.col("n") * HOT_NODES > total).select("node", "depth", "heavy")
    rest = heavy.filter(F.col("n") * HOT_NODES <= total).select("node", "depth", "heavy")
    left = rows.join(F.broadcast(hot.select("node", "depth", F.col("heavy").alias("found"))), ["node", "depth"], "left")
    left = stored(left.filter(F.col("found").isNull() | (F.col("found") != F.col("c"))), "ways")
    cold = left.filter("found IS NULL").drop("found").join(rest, ["node", "depth"]).filter("heavy <> c")
    return left.filter("found IS NOT NULL").withColumnRenamed("found", "heavy").select(cold.columns).unionByName(cold)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near): both directions of every pair of words exactly one inserted, deleted or replaced code point apart.

    vocabulary: distinct words (word, n). Words of one group of light ones that differ in one character are at most as many as the
    alphabet has letters.
    """
    light = stored(light_rows(vocabulary).mapInArrow(_lookups, "id bigint, target bigint, met string"), "light")
    names = stored(vocabulary.select("word", "n").mapInArrow(_named, "id bigint, word string, n bigint"), "names")
    looked = light.filter("met IS NULL").select("id", "target").join(names.select(F.col("id").alias("target")).distinct(), "target")
    groups = light.filter("met IS NOT NULL").select("id", "target", "met")
    several = groups.groupBy("target", "met").agg(F.count("*").alias("k")).filter("k > 1").select("target", "met")
    met = groups.join(several, ["target", "met"])
    other = met.select("target", "met", F.col("id").alias("other"))
    pairs = looked.unionByName(met.join(other, ["target", "met"]).filter("id < other").select("id", F.col("other").alias("target"))).distinct()
    a, b = names.select("id", "word"), names.select(F.col("id").alias("target"), F.col("word").alias("near"))
    one = pairs.join(a, "id").join(b, "target").filter(F.levenshtein("word", "near", 1) == 1).select("word", "near").distinct()
    one = stored(one, "pairs")
    return one.unionByName(one.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, target, met): hashes to look up; met is set where light words of a node meet instead.

    Of a word, its prefix and the character c behind it, at place p: without c it is prefix + (word - prefix - c R^p) / R, with c counted
    as nothing word - c R^p, and with a place opened before c prefix + (word - prefix) R; the heavy character adds itself times R^p."""
    for batch in batches:
        get = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("node", "depth", "c", "id", "again", "heavy")}
        prefix, word = (get[n].view(np.uint64) for n in ("node", "id"))
        power = _powers(int(get["depth"].max(initial=0)))[0][get["depth"]]
        c, heavy = (get[n].astype(np.uint64) * power for n in ("c", "heavy"))
        ends, lasts = get["c"] == 0, get["heavy"] == 0
        zeroed = word - c
        found = [(~ends & ~lasts, zeroed + heavy), (~lasts, prefix + (word - prefix) * np.uint64(_R) + heavy),
                 (~ends & ~get["again"], prefix + (word - prefix - c) * np.uint64(_R_INVERSE)), (~ends, zeroed)]
        ids, targets = (np.concatenate(x).view(np.int64) for x in zip(*((word[take], to[take]) for take, to in found), strict=True))
        n = len(ids) - int((~ends).sum())
        met = pa.concat_arrays([pa.array([None] * n, pa.string()), pa.array(get["depth"][~ends]).cast(pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(targets), met], ["id", "target", "met"])


# Forms ----------------------------------------------------------------------------------------------------------------


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n).

    form is the near word of largest n (ties: smallest in code-point order) if that n is at least ratio times the word's, else null;
    root is the last of the forms from the word on, the word itself if it has none. Repeated words must be added up before. An
    empty vocabulary gives no rows; a null word is passed over; words of any length are compared whole.
    """
    vocabulary = stored(vocabulary.filter("word IS NOT NULL").select("word", "n"), "vocabulary")
    pairs = near_pairs(vocabulary).join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    fits = -F.col("best.minus") >= ratio * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    formed = stored(formed, "forms")
    roots = stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    # Counts grow by the ratio along a chain, so its length is bounded, and every round doubles what has been followed.
    most = formed.agg(F.max("n")).first()[0] or 1
    longest = 1
    while ratio ** (longest + 1) <= most:
        longest += 1
    for _ in range(ceil(log2(longest))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, roots = roots, stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        forget(last)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`variants` of the words of whole texts. A null text has no words, a null id is the empty one in the rule that deletes
    characters. Repeated rows count each. Other columns are ignored, whatever their names; an empty table gives no rows."""
    return variants(words(docs, doc_id, text))
