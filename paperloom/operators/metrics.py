"""Aggregates of the library: storage by group, fingerprints of collections, quotas."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.scratch import stored

#: Characters of a piece of sorted lines.
PIECE = 1 << 13


def storage_report(files: DataFrame, group: Column, size: Column) -> DataFrame:
    """Files and bytes by group and in total."""
    rows = files.select(group.alias("grp"), size.alias("size"))
    return rows.rollup("grp").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.grouping("grp").alias("g")).select(
        F.when(F.col("g") == 1, "total").otherwise(F.col("grp")).alias("grp"), "files", "bytes")


def _packed(batches):
    """Runs of sorted lines of one key as pieces of about PIECE characters: key, partition, number, piece (null: no line)."""
    part, n = TaskContext.get().partitionId(), 0
    key, held, size, begun = None, [], 0, False

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array(["\n".join(held) if held else None], pa.large_string())], ["key", "part", "n", "piece"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if begun and (k != key or size >= PIECE):
                yield piece()
                n, held, size = n + 1, [], 0
            key, begun = k, True
            if line is not None:
                held.append(line)
                size += len(line) + 1
    if begun:
        yield piece()


def _hashed(batches):
    """The SHA-256 of each key's pieces, which come in order: key, digest."""
    key, state, lines, begun = None, hashlib.sha256(), False, False
    for batch in batches:
        kind = batch.schema.field(0).type
        for k, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if begun and k != key:
                yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], ["key", "digest"])
                state, lines = hashlib.sha256(), False
            key, begun = k, True
            if text is not None:
                state.update(("\n" if lines else "").encode() + text.encode())
                lines = True
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], ["key", "digest"])


def fingerprint(lines: DataFrame, key: str, line: str, name: str = "fingerprint") -> DataFrame:
    """SHA-256 of the sorted lines of each key, whatever order they come in; null lines are passed over.

    All lines are sorted together by ranges, so a frequent key is sorted by many tasks. Only the hash, which must read a key's
    lines in turn, is one task a key; it streams over pieces and holds one batch of them.
    """
    kind = lines.select(key).schema[0].dataType.simpleString()
    rows = lines.select(F.col(key).alias("key"), F.col(line).cast("string").alias("line")).orderBy("key", "line")
    pieces = rows.mapInArrow(_packed, f"key {kind}, part int, n bigint, piece string")
    digests = pieces.repartition("key").sortWithinPartitions("key", "part", "n").mapInArrow(_hashed, f"key {kind}, digest string")
    return digests.select(F.col("key").alias(key), F.col("digest").alias(name))


def document_fingerprint(docs: DataFrame, highlights: DataFrame, key: str = "id", foreign_key: str = "docId") -> DataFrame:
    """SHA-256 of a document's JSON, a zero byte, and the JSON of its highlights in order of id."""
    marks = highlights.groupBy(F.col(foreign_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in highlights.columns if c != "id"]))).alias("_m"))
    joined = docs.join(marks, F.col(key) == F.col("_k"), "left")
    text = F.concat(F.to_json(F.struct(*docs.columns)), F.lit("\x00"), F.coalesce(F.to_json("_m"), F.lit("[]")))
    return joined.select(key, F.sha2(text, 256).alias("meta"))


def quota(rows: DataFrame, later: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows, those with later = 0 before others. A bounded top-k."""
    return rows.orderBy(F.asc(later), *order).limit(most)


def occurrences(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The number of each row among those of equal key, and how many there are; nulls equal each other.

    Rows are cut into ranges of key and order, so a key that very many rows have lies in many of them: a row's number is its place
    in its range and the rows of its key in the ranges before."""
    parts = stored(rows.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_part").alias("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*key)).alias("n_equal"))
    same = F.col("_part") == F.col("_range")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order))
    numbered = parts.withColumn("_inside", inside).join(counts, same)
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("int").alias("occurrence"), "n_equal")
