"""Folding small groups that need a state: rows are dealt out by key and sorted by Spark, a task walks them and holds one group."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a result batch.
BATCH_ROWS = 4096


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all cores by their keys, for work that is heavy a row: a small file of very many rows is a single task otherwise.
    A number of parts is given, as Spark would put small parts together again."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def fold_groups(rows: DataFrame, by: list[str], order: list[str], fold: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples that fold makes of each group's rows (dictionaries, in order). For groups as large as a page or a document."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def walked(batches):
        key, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[c] for c in by)
                if held and now != key:
                    out += fold(held)
                    held = []
                    if len(out) >= BATCH_ROWS:
                        yield made(out)
                        out = []
                key = now
                held.append(row)
        if held:
            out += fold(held)
        yield made(out)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(walked, schema)
