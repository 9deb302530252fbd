"""SimHash near-duplicates with pivot distance tables.

Fingerprints: the bitwise majority of the XXH64 of every four-word shingle of the lower-cased text. Two fingerprints link at
a Hamming distance of MAX_BITS or less, and near-duplicate groups are the components of the links.

Distinct fingerprints meet in buckets: cut into b blocks of bits, two fingerprints with at most four different bits agree in
b - 4 blocks, so a bucket for each choice of b - 4 blocks brings every link together (pigeonhole, exact). Inside a bucket
each fingerprint has its row of Hamming distances to many fixed reference fingerprints (pivots); by the triangle inequality
a pair whose rows differ by more than MAX_BITS in any coordinate is discarded, and only survivors are compared. Pairs that
are already connected in the bucket are not compared again, and a bucket reports its components as stars, never its pairs.
A bucket of more than SLICE fingerprints is dealt out as pairs of slices, so no task holds more than two slices. A bucket that
would take more than MAX_SLICES slices is bucketed again: the bits that its members need not share are cut into SUB_BLOCKS
blocks, and they meet in a bucket for each choice of all but four. So a fingerprint is copied at most C(SUB_BLOCKS, 4) times a
level however large its bucket is, and levels end because each shares more bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.operators.components import components
from paperloom.llm.tables import stored

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Fingerprints that one slice of a bucket holds, slices of a bucket before it is bucketed again, and the blocks that then are made.
SLICE, MAX_SLICES, SUB_BLOCKS = 4096, 64, 8
#: The most hot buckets whose counts are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
#: The most ids of documents to drop that are broadcast (16 MB); more are joined by a shuffle.
MAX_GONE = 1_000_000
#: Reference fingerprints: fixed and spread out, from a multiplicative rule.
PIVOTS = W.mixed(np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SEGMENT = 60_000  # shingles that a 16-bit counter can take


def _majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its consecutive hashes: bits set in over half of them."""
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    parts = -(-count[full] // _SEGMENT)
    owner = np.repeat(np.arange(len(full)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = first[full][owner] + nth * _SEGMENT
    ones = np.zeros((len(full), 64), np.int64)
    lanes = np.uint64(0x0001000100010001)
    for k in range(16):
        sums = np.add.reduceat((h >> np.uint64(k)) & lanes, starts)
        for lane in range(4):
            np.add.at(ones[:, 16 * lane + k], owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    major = 2 * ones > count[full][:, None]
    out[full] = (major.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts in one buffer; a text of fewer than SHINGLE words is one shingle, one without words gives zero."""
    data = W.LOWER[data]
    found = W.find(data, at, W.NOT_BLANK)
    if not len(found.start):
        return np.zeros(len(at) - 1, np.uint64)
    # Words joined by single spaces: of the bytes between words only the first is kept.
    inside = W.NOT_BLANK[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    to = np.cumsum(keep) - 1
    joined = np.where(inside, data, 0x20).astype(np.uint8)[keep].tobytes()
    start, end = to[found.start], to[found.end - 1] + 1
    count = found.counts()
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    low = np.repeat(found.first[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    high = np.minimum(low + SHINGLE, np.repeat(found.first[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[low].tolist(), end[high].tolist(), strict=True)), np.uint64, len(low))
    return _majority(h, shingles)


def _fingerprinted(batches):
    for batch in batches:
        for row, end, data, at in W.pieces(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(fingerprints_of(data, at).view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the 64 bits of every row's fingerprint as a signed long."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(_fingerprinted, f"id {rows.schema[0].dataType.simpleString()}, fp bigint")


def _groups(x: np.ndarray) -> np.ndarray:
    """For each of distinct fingerprints the place of one member of its component."""
    table = np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    x, table = x[order], table[order]
    label, left = np.arange(len(x)), len(x)
    upto = np.searchsorted(table[:, 0], table[:, 0] + MAX_BITS, "right")
    for r in range(len(x)):
        others = r + 1 + np.flatnonzero(label[r + 1 : upto[r]] != label[r])
        if len(others):
            others = others[(np.abs(table[others] - table[r]) <= MAX_BITS).all(axis=1)]
            others = others[np.bitwise_count(x[others] ^ x[r]) <= MAX_BITS]
            for old in np.unique(label[others]):
                label[label == old] = label[r]
                left -= 1
            if left == 1:
                break
    out = np.empty(len(x), np.int64)
    out[order] = order[label]
    return out


def _bucket_links(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components of every bucket; rows of a bucket stand together."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(edge)
    run = np.repeat(np.arange(len(size)), size)
    us, vs = [], []
    few = np.flatnonzero((size[run] > 1) & (size[run] <= 8))
    y, run_of = x[few], run[few]
    table = np.bitwise_count(y[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    for s in range(1, 8):
        i = np.flatnonzero(run_of[s:] == run_of[:-s])
        i = i[(np.abs(table[i] - table[i + s]) <= MAX_BITS).all(axis=1)]
        i = i[np.bitwise_count(y[i] ^ y[i + s]) <= MAX_BITS]
        us.append(y[i]), vs.append(y[i + s])
    for k in np.flatnonzero(size > 8):
        y = x[edge[k] : edge[k + 1]]
        root = _groups(y)
        i = np.flatnonzero(root != np.arange(len(y)))
        us.append(y[i]), vs.append(y[root[i]])
    return np.concatenate(us), np.concatenate(vs)


def _starts(batch) -> np.ndarray:
    """Whether each row begins a bucket: another free, value or part than the row before."""
    new = np.ones(len(batch), bool)
    new[1:] = False
    for column in batch.columns[:3]:
        x = column.to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _links(batches):
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        cut = int(np.flatnonzero(_starts(rest))[-1]) if len(rest) else 0
        if cut:
            yield from _emitted(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield from _emitted(rest)


def _emitted(batch):
    u, v = _bucket_links(np.cumsum(_starts(batch)), batch.column(3).to_numpy().view(np.uint64))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def _blocks(distinct: int) -> int:
    """Blocks of bits: more for more fingerprints, so that buckets stay small; exact with any number over MAX_BITS."""
    return next((b for b, most in ((6, 1 << 23), (7, 1 << 28), (8, 1 << 33)) if distinct <= most), 9)


def _free_masks(free: int, blocks: int) -> list[int]:
    """The bits of `free` in blocks; for each choice of MAX_BITS blocks the mask of their bits, which members need not share."""
    bits = [k for k in range(64) if free >> k & 1]
    edges = [round(len(bits) * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << k for k in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return sorted({sum(chosen) for chosen in combinations(parts, MAX_BITS)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucketed(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(free, value, fp) of rows (free, fp): a bucket for each mask that free leads to; a few thousand masks at most."""
    pairs = [(_signed(free), _signed(m)) for free, then in masks.items() for m in then]
    table = F.broadcast(rows.sparkSession.createDataFrame(pairs, "free long, next long"))
    out = rows.join(table, "free").select(F.col("next").alias("free"), F.col("fp").bitwiseAND(F.bitwise_not("next")).alias("value"), "fp")
    return out.distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) whose components are those of all links."""
    fps = fps.filter(F.col("fp").isNotNull()).distinct()
    masks = {(1 << 64) - 1: _free_masks((1 << 64) - 1, _blocks(fps.count()))}
    keyed, found = _bucketed(fps.select(F.lit(-1).cast("long").alias("free"), "fp"), masks), []
    while True:
        hot = stored(keyed.groupBy("free", "value").count().filter(F.col("count") > SLICE)
                     .select("free", "value", F.ceil(F.col("count") / SLICE).cast("int").alias("slices")), "hot")
        n_hot = hot.count()
        again = n_hot > 0 and not hot.filter(F.col("slices") > MAX_SLICES).isEmpty()
        if n_hot:
            keyed = keyed.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST else hot, ["free", "value"], "left")
            if again:
                keyed = stored(keyed, "buckets")
            fits = keyed.filter(F.coalesce("slices", F.lit(1)) <= MAX_SLICES).withColumn("slices", F.coalesce("slices", F.lit(1)))
            fits = fits.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            part = (F.least("own", "other") * F.col("slices") + F.greatest("own", "other")).cast("long")
            dealt = fits.select("free", "value", part.alias("part"), "fp")
        else:
            dealt = keyed.select("free", "value", F.lit(0).cast("long").alias("part"), "fp")
        found.append(dealt.repartition("free", "value", "part").sortWithinPartitions("free", "value", "part").mapInArrow(_links, "u bigint, v bigint"))
        if not again:
            return reduce(DataFrame.union, found)
        masks = {m: _free_masks(m, SUB_BLOCKS) for m in sorted({m for then in masks.values() for m in then})}
        rest = keyed.filter(F.col("slices") > MAX_SLICES)
        keyed = _bucketed(rest.select("free", "fp"), masks)


def _groups_of(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of stored rows (id, fp)."""
    roots = components(links(rows.select("fp")))
    by_fp = rows.groupBy("fp").agg(F.min("id").alias("id")).join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    by_fp = stored(by_fp, "roots")
    # Stored, so that the join has a plain exchange on either side and a root with very many fingerprints can be split.
    smallest = stored(by_fp.groupBy("root").agg(F.min("id").alias("component_id")), "smallest")
    return by_fp.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id of the row's near-duplicate group.

    Null and wordless texts have fingerprint zero, linked like any other. A null doc_id takes part in linking and is never a
    component_id unless a group has no other. Very long texts count whole. Repeated rows stay rows. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, doc_id, text), "fingerprints")
    return rows.join(_groups_of(rows), "fp").select(F.col("id").alias(doc_id), "fp", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that represent their near-duplicate group, all columns kept: those with the group's smallest id.

    A row without an id represents only a group that has no id at all; where several rows could (they repeat the id, or have
    none) one of them does. Null, empty and very long texts are as in near_duplicates; columns may have any names; an empty
    table gives no rows.
    """
    rows = stored(fingerprints(docs, doc_id, text), "fingerprints")
    groups = stored(_groups_of(rows), "groups")
    matches = F.col("id").eqNullSafe(F.col("component_id"))
    ids = rows.join(groups, "fp").groupBy("id").agg(F.count("*").alias("n"), F.count_if(matches).alias("kept"))
    gone = stored(ids.filter("n > 1 OR id IS NULL OR kept = 0").select(F.col("id").alias("gone_id"), (F.col("id").isNull() | (F.col("n") > 1)).alias("several")), "gone")
    original = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("original"))  # one column, so that no name clashes
    own_id = F.col(f"original.`{doc_id}`")
    out = original.join(F.broadcast(gone) if gone.count() <= MAX_GONE else gone, own_id.eqNullSafe(F.col("gone_id")), "left_anti")
    several = gone.filter("several").select(F.col("gone_id").alias("several_id"))
    if not several.isEmpty():
        some = original.join(several, own_id.eqNullSafe(F.col("several_id")), "left_semi").select(F.col("original").alias("id"), F.col(f"original.`{text}`").alias("t"))
        found = some.mapInArrow(_fingerprinted, f"id {some.schema[0].dataType.simpleString()}, fp bigint").join(groups, "fp")
        found = found.filter(F.col(f"id.`{doc_id}`").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
        out = out.unionByName(found.select(F.col("id").alias("original")))
    return out.select("original.*")
