"""A paged item feed with a version cursor as a Python data source, batch and stream.

    spark.dataSource.register(ItemFeed)
    spark.read.format("item_feed").option("since", 40).load(folder)      # items of later versions
    spark.readStream.format("item_feed").load(folder)                   # the version is the offset

The folder stands for the remote library: JSON lines (key, version, body) in files that pyarrow can open.
"""

from __future__ import annotations

import io
import json

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _items(folder: str, name: str | None = None):
    store, path = fs.FileSystem.from_uri(folder)
    for info in store.get_file_info(fs.FileSelector(path)):
        if info.is_file and info.path.endswith(".jsonl") and name in (None, info.path):
            with store.open_input_stream(info.path) as file:
                for line in io.TextIOWrapper(io.BufferedReader(file), "utf-8"):
                    item = json.loads(line)
                    yield item["key"], int(item["version"]), item.get("body")


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Batch(DataSourceReader):
    def __init__(self, folder: str, since: int):
        self.folder, self.since = folder, since

    def partitions(self):
        store, path = fs.FileSystem.from_uri(self.folder)
        return [_Page(i.path) for i in store.get_file_info(fs.FileSelector(path)) if i.is_file and i.path.endswith(".jsonl")]

    def read(self, partition):
        return (row for row in _items(self.folder, partition.path) if row[1] > self.since)


class _Span(_Page):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(path)
        self.start, self.end = start, end


class _Stream(DataSourceStreamReader):
    """A partition for each file; the driver reads versions only, and holds the largest."""

    def __init__(self, folder: str, since: int):
        self.folder, self.since, self.latest = folder, since, since

    def initialOffset(self):
        return {"version": self.since}

    def latestOffset(self):
        self.latest = max(self.latest, max((r[1] for r in _items(self.folder)), default=self.latest))
        return {"version": self.latest}

    def partitions(self, start, end):
        return [_Span(page.path, start["version"], end["version"]) for page in _Batch(self.folder, 0).partitions()]

    def read(self, partition):
        return (row for row in _items(self.folder, partition.path) if partition.start < row[1] <= partition.end)


class ItemFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "item_feed"

    def schema(self) -> str:
        return "key string, version bigint, body string"

    def reader(self, schema):
        return _Batch(self.options["path"], int(self.options.get("since", 0)))

    def streamReader(self, schema):
        return _Stream(self.options["path"], int(self.options.get("since", 0)))
