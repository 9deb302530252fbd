"""Views that follow changing inputs. Each works on a batch and, where marked, on a stream of the same rows.

Event-time windows stand for timers: a debounce is a session window that ends after a gap, a throttle a tumbling window.
Streams need a watermark; rows later than it are dropped, which the batch twin never does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, folder: str, schema: str, late: tuple[str, str] | None = None, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder; late: event-time column and how long to wait for stragglers."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = reader.parquet(folder)
    return rows.withWatermark(*late) if late else rows


def refreshed(changes: DataFrame, view: Callable[[SparkSession], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """A reactive query: each batch of changes makes the whole view anew, under a new version of target that readers switch to
    only when it is complete. Runs until the changes at hand are used up."""
    def again(_: DataFrame, batch: int) -> None:
        view(changes.sparkSession).write.mode("overwrite").parquet(f"{target}/v={batch}")

    return changes.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed_from(sources: list[DataFrame], view: Callable[[SparkSession], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """A view over several tables: a change of any of them (streams of any columns) makes the whole view anew, once a batch."""
    marks = [s.select(F.lit(n).alias("source")) for n, s in enumerate(sources)]
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    return refreshed(every, view, target, checkpoint)


def tool_calls(fragments: DataFrame, stream: str, index: str, order: str) -> DataFrame:
    """Calls put together from their fragments (id, name, arguments): of each stream and index the first id and name, and the
    arguments in order; a call without a name is none."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order)))
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce("arguments", F.lit("")).alias("a"))))
    calls = fragments.groupBy(stream, index).agg(first("id").alias("id"), first("name").alias("name"), parts.alias("p"))
    return calls.filter(F.coalesce("name", F.lit("")) != "").select(stream, index, "id", "name", F.array_join(F.transform("p", lambda x: x["a"]), "").alias("arguments"))


def debounced(rows: DataFrame, key: str, at: str, value: str, gap: str) -> DataFrame:
    """The last value of each burst; a burst ends when nothing comes for gap. Batch or stream."""
    burst = rows.groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.max(F.struct(at, value)).alias("last"), F.count("*").alias("n_events"))
    return burst.select(key, F.col("w.start").cast("timestamp_ntz").alias("started"), F.col(f"last.{value}").alias("last_event"), "n_events")


def throttled(rows: DataFrame, key: str, at: str, value: str, every: str) -> DataFrame:
    """The last value of each slot of time. Batch or stream."""
    slot = rows.groupBy(F.col(key), F.window(at, every).alias("w")).agg(F.max(F.struct(at, value)).alias("last"), F.count("*").alias("n_events"))
    return slot.select(key, F.col("w.start").cast("timestamp_ntz").alias("slot"), F.col(f"last.{value}").alias("last_event"), "n_events")


def changes(rows: DataFrame, key: str, order: list[str], value: str, least: float) -> DataFrame:
    """Rows whose value differs by at least `least` from the row before of the same key. Batch."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | (F.abs(F.col(value) - F.col("_before")) >= least)).drop("_before")


def changes_stream(rows: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """The stream of changes(): the last value of each key is its state. Rows of a batch are taken in order."""
    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(parts)).sort_values(order)
        kept = []
        for n, v in zip(frame[order], frame[value], strict=True):
            if last is None or abs(v - last) >= least:
                kept.append((group[0], n, v))
            last = v
        state.update((float(last),))
        yield pd.DataFrame(kept, columns=[key, order, value])

    kinds = dict(rows.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double"
    return rows.groupBy(key).applyInPandasWithState(step, out, "last double", "append", GroupStateTimeout.NoTimeout)


def folded(rows: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """Deltas of each stream joined in their order. Batch."""
    parts = F.array_sort(F.collect_list(F.struct(order, delta)))
    return rows.groupBy(key).agg(parts.alias("p"), F.count("*").alias("n_deltas")).select(key, F.array_join(F.transform("p", lambda x: x[delta]), "").alias("text"), "n_deltas")


def folded_stream(rows: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """The text of each stream so far, after each batch: the text is the state. Deltas of a batch are put in order; a batch
    never holds deltas older than those of a batch before (as in a response stream)."""
    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = state.get if state.exists else ("", 0)
        frame = pd.concat(list(parts)).sort_values(order)
        text, n = text + "".join(frame[delta].fillna("")), n + len(frame)
        state.update((text, n))
        yield pd.DataFrame([(group[0], text, n)], columns=[key, "text", "n_deltas"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, text string, n_deltas bigint", "text string, n bigint", "update", GroupStateTimeout.NoTimeout)


def sse_deltas(events: DataFrame, body: str = "value") -> DataFrame:
    """Payloads of server-sent events: the `data:` lines of each event joined, without [DONE] and without broken JSON. Batch or stream."""
    event = F.explode(F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n+"))
    lines = F.filter(F.split("event", "\n"), lambda s: F.startswith(s, F.lit("data:")))
    data = F.array_join(F.transform(lines, lambda s: F.trim(F.substring(s, 6, 1 << 30))), "\n")
    rows = events.withColumn("event", event).withColumn("data", data).filter((F.col("data") != "") & (F.col("data") != "[DONE]"))
    return rows.filter(F.try_parse_json("data").isNotNull()).drop("event", body)


#: Statuses that end all steps of an activity.
TERMINAL = ("completed", "failed", "cancelled")


def activity_steps(events: DataFrame, key: str = "session") -> DataFrame:
    """Activity records from events (ordinal, kind, id, status, text) of each session.

    Reasoning texts are one step until a text comes; tools are steps by id, with their last status; a terminal event closes
    every step that still runs. Events of a session are folded in order, one session a group.
    """
    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        steps: list[dict] = []
        reasoning = None
        for e in frame.sort_values("ordinal").itertuples(index=False):
            if e.kind == "reasoning":
                if reasoning is None:
                    reasoning = {"kind": "reasoning", "id": "", "status": "running", "text": ""}
                    steps.append(reasoning)
                reasoning["text"] += e.text or ""
            elif e.kind == "text":
                if reasoning is not None:
                    reasoning["status"] = "completed"
                    reasoning = None
            elif e.kind == "tool":
                step = next((s for s in steps if s["kind"] == "tool" and s["id"] == e.id), None)
                if step is None:
                    steps.append(step := {"kind": "tool", "id": e.id, "status": "running", "text": ""})
                step["status"], step["text"] = e.status or step["status"], step["text"] + (e.text or "")
            elif e.kind == "status" and e.status in TERMINAL:
                for step in steps:
                    step["status"] = e.status if step["status"] == "running" else step["status"]
                reasoning = None
        return pd.DataFrame([(frame[key].iloc[0], n, s["kind"], s["id"], s["status"], s["text"]) for n, s in enumerate(steps)], columns=[key, "step", "kind", "id", "status", "text"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandas(fold, f"{key} {kind}, step int, kind string, id string, status string, text string")


def since(items: DataFrame, version: str, cursor: int) -> DataFrame:
    """Items changed after a version cursor; all of them from cursor 0. The filter reaches the scan."""
    return items.filter(F.col(version) > cursor) if cursor else items


def live_only(rows: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Results whose row still exists; others are stale and dropped. Batch, or a stream against a batch."""
    return rows.join(live.select(key), key, "left_semi")


def newest_write(rows: DataFrame, key: str, request: str) -> DataFrame:
    """Of overlapping writes to a key the one of the latest request, whenever it ended; others are marked superseded."""
    last = F.max(request).over(Window.partitionBy(key))
    return rows.withColumn("superseded", F.col(request) < last)
