"""Mixing overlapping sources to target weights, by min-cost flow over membership patterns.

A document may belong to several sources. Documents are added up by the set of sources they belong to, their pattern; what is
solved is a flow of tokens from patterns to the sources' quotas. A pattern can be taken several times, each time at a higher
cost, so the flow repeats nothing while fresh text is left that can reach the quota, along whatever detour over other patterns.
A pattern's flow is then a number of whole laps over its documents and a rest; the documents of the rest are the first in a
seeded order, found by hash buckets, and one more whose size comes nearest to what is still missing.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.tables import stored

#: Patterns are routed on the driver: more of them are an error.
MAX_PATTERNS = 100_000
#: Rows that a bucket of the seeded order is meant to hold, and the most buckets of a pattern.
BUCKET_ROWS, MAX_BUCKETS = 500, 16_384
#: Copies of one row that are listed by one array.
LIST_ROWS = 65_536
#: What it costs to take a token the first time, the second time, ...; must not fall.
REPEAT_COSTS = (0, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The default size of a document: its words, none if the text is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def filled(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of the total by weight, none above most times its size; what is cut off is shared again by weight."""
    caps = [most * s for s in sizes]
    left, weight = float(total), sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i)):
        if caps[i] / weights[i] > left / weight:
            break
        left, weight = left - caps[i], weight - weights[i]
    level = left / weight if weight else 0.0
    full = not weight
    return [c if full else min(c, level * w) for c, w in zip(caps, weights, strict=True)]


class _Flow:
    """A flow network whose arcs can be widened after a flow has been found; arcs 2i and 2i + 1 are each other's reverse."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for here, there, r in ((a, b, room), (b, a, 0)):
            self.out[here].append(len(self.to))
            self.to.append(there)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, source: int, sink: int) -> list[int] | None:
        level, todo = [-1] * len(self.out), deque([source])
        level[source] = 0
        while todo:
            at = todo.popleft()
            for arc in self.out[at]:
                if self.room[arc] and level[self.to[arc]] < 0:
                    level[self.to[arc]] = level[at] + 1
                    todo.append(self.to[arc])
        return level if level[sink] >= 0 else None

    def fill(self, source: int, sink: int) -> None:
        """Add the most flow that the room left allows: blocking flows over ever longer shortest paths."""
        while (level := self._levels(source, sink)) is not None:
            tried, path, at = [0] * len(self.out), [], source
            while True:
                if at == sink:
                    flow = min(self.room[a] for a in path)
                    for a in path:
                        self.room[a] -= flow
                        self.room[a ^ 1] += flow
                    first = next(i for i, a in enumerate(path) if not self.room[a])
                    at = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while tried[at] < len(self.out[at]):
                    arc = self.out[at][tried[at]]
                    if self.room[arc] and level[self.to[arc]] == level[at] + 1:
                        break
                    tried[at] += 1
                if tried[at] < len(self.out[at]):
                    path.append(arc)
                    at = self.to[arc]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def routed(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[float] = REPEAT_COSTS) -> list[dict[int, int]]:
    """For every pattern (its size, its sources by number) the tokens that go to each source, at least cost.

    All that the quotas can take and the patterns can give flows. Every way to the sink enters by one pattern's arc of one lap, so
    shortest ways have the costs of laps, the same for all patterns: filling the network lap by lap, keeping the flow so far and
    all its ways back, is the successive-shortest-path method with all ways of a length at once.
    """
    if any(b < a for a, b in zip(costs, costs[1:], strict=False)):
        raise ValueError("the costs of repeating must not fall")
    n = len(sizes)
    source, sink = n + len(quotas), n + len(quotas) + 1
    net = _Flow(sink + 1)
    entry = [net.arc(source, p, 0) for p in range(n)]
    ways = [{s: net.arc(p, n + s, len(costs) * sizes[p]) for s in members[p]} for p in range(n)]
    for s, quota in enumerate(quotas):
        net.arc(n + s, sink, quota)
    for _ in costs:
        for p in range(n):
            net.room[entry[p]] += sizes[p]
        net.fill(source, sink)
    return [{s: net.room[arc ^ 1] for s, arc in way.items() if net.room[arc ^ 1]} for way in ways]


@dataclass
class Mixture:
    """sources: (source, source_size, weight, target, routed tokens); patterns: (pattern, size, laps, rest, by source); documents: one row per row."""

    sources: list[dict]
    patterns: list[dict]
    documents: DataFrame


def mix(docs: DataFrame, memberships: Column, weights: Sequence[float] | Mapping[str | None, float], share: float = 1.5, most: float = 2.0,
        costs: Sequence[float] = REPEAT_COSTS, seed: str = "0", key: str = "doc_id", size: Column | None = None) -> Mixture:
    """Choose how often each document is taken. documents has key, size, pattern (JSON of the sources in order) and taken, the
    tokens of all times together, for every row.

    memberships: array of a row's sources; repeated ones count once, null is a source like any other, and without any nothing is
    taken. weights: by source, or a list that repeats over the sources in code-point order, null last. Targets share that part of
    all sizes, by weight, none above most times its source. size: by default the words of column text. Rows that agree in key, size
    and sources are interchangeable, each is decided on its own. Null keys are ordered like the empty one. Reruns choose the same. An
    empty table gives no rows. Documents without words are never taken; very long ones count whole. Other columns are ignored.
    """
    size = word_count(F.col("text")) if size is None else size
    listed = F.to_json(F.array_sort(F.array_distinct(F.coalesce(memberships, F.array().cast("array<string>")))))
    rows = docs.select(F.col(key).alias("key"), size.alias("size"), listed.alias("pattern"))
    rows = stored(rows.groupBy("key", "size", "pattern").agg(F.count("*").alias("copies")), "sizes")
    counts = rows.groupBy("pattern").agg(F.sum(F.col("size") * F.col("copies")).alias("total"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(counts) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} patterns of sources")
    counts.sort(key=lambda r: r["pattern"])
    members = [json.loads(r["pattern"]) for r in counts]
    names = sorted({s for m in members for s in m}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for m, r in zip(members, counts, strict=True):
        for s in m:
            sizes[number[s]] += r["total"]
    weight = [weights[s] if isinstance(weights, Mapping) else weights[i % len(weights)] for i, s in enumerate(names)]
    targets = filled(sizes, weight, share * sum(r["total"] for r in counts), most) if names else []
    ways = routed([r["total"] for r in counts], [[number[s] for s in m] for m in members], [int(t) for t in targets], costs)
    sources = [{"source": s, "source_size": sizes[i], "weight": weight[i], "target": targets[i], "routed": sum(w.get(i, 0) for w in ways)} for i, s in enumerate(names)]
    patterns = []
    for r, way in zip(counts, ways, strict=True):
        laps, rest = divmod(sum(way.values()), r["total"]) if r["total"] else (0, 0)
        patterns.append({"pattern": r["pattern"], "total": r["total"], "laps": laps, "rest": rest, "by_source": {names[s]: n for s, n in way.items()}})
    return Mixture(sources, patterns, _selected(rows, patterns, max((r["n"] for r in counts), default=0), seed).withColumnRenamed("key", key))


def _selected(rows: DataFrame, patterns: list[dict], most_rows: int, seed: str) -> DataFrame:
    """(key, size, pattern, taken) of every row: its pattern's laps, and one more for those that make up the rest."""
    spark = rows.sparkSession
    told = F.broadcast(spark.createDataFrame([(p["pattern"], p["laps"], p["rest"]) for p in patterns], "pattern string, laps bigint, rest bigint"))
    buckets = max(1, min(MAX_BUCKETS, most_rows // BUCKET_ROWS))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("")), "size").cast("binary"))
    unit = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = rows.withColumn("order", order).withColumn("bucket", F.floor(unit * buckets).cast("int")).withColumn("whole", F.col("size") * F.col("copies"))
    upto = Window.partitionBy("pattern").orderBy("bucket")
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("whole").alias("here")).withColumn("end", F.sum("here").over(upto)).join(told, "pattern")
    # The bucket in which the rest ends; of the buckets of a pattern it is the first that reaches beyond.
    cut = sums.filter(F.col("end") > F.col("rest")).groupBy("pattern").agg(F.min_by(F.struct("bucket", (F.col("end") - F.col("here")).alias("before")), "bucket").alias("cut"))
    cut = F.broadcast(cut.select("pattern", F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before")))
    joined = rows.join(told, "pattern").join(cut, "pattern", "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))
    apart = joined.filter(F.col("bucket") != F.col("cut")).withColumn("again", F.when(F.col("bucket") < F.col("cut"), F.col("copies")).otherwise(F.lit(0).cast("long")))
    inside = Window.partitionBy("pattern").orderBy("order", "key", "size")
    room = F.col("rest") - F.col("before") - (F.sum("whole").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole"))
    fitting = F.when(F.col("size") > 0, F.least("copies", F.greatest(F.lit(0).cast("long"), F.floor(room / F.col("size"))))).otherwise(F.lit(0).cast("long"))
    edge = joined.filter(F.col("bucket") == F.col("cut")).withColumn("again", fitting)
    decided = stored(apart.unionByName(edge), "decided")
    gaps = decided.groupBy("pattern").agg((F.first("rest") - F.sum(F.col("size") * F.col("again"))).alias("gap")).filter("gap > 0")
    spare = decided.filter((F.col("again") < F.col("copies")) & (F.col("size") > 0)).join(F.broadcast(gaps), "pattern").withColumn("off", F.abs(F.col("size") - F.col("gap")))
    best = spare.filter(F.col("off") < F.col("gap")).groupBy("pattern").agg(F.min(F.struct("off", "order", "key", "size")).alias("b"))
    best = F.broadcast(best.select(F.col("pattern").alias("p"), F.col("b.key").alias("k"), F.col("b.size").alias("s"), F.lit(1).cast("long").alias("one")))
    final = decided.join(best, (F.col("pattern") == F.col("p")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("size") == F.col("s")), "left")
    again = F.col("again") + F.coalesce("one", F.lit(0))
    # Equal rows are listed from their count, in stretches, so that a million of them are no array of a million.
    stretches = final.withColumn("again", again).withColumn("stretch", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {LIST_ROWS}"))))
    ends = F.least(F.col("copies"), (F.col("stretch") + 1) * LIST_ROWS)
    copies = stretches.withColumn("copy", F.explode(F.sequence(F.col("stretch") * LIST_ROWS + 1, ends)))
    taken = F.col("size") * (F.col("laps") + F.when(F.col("copy") <= F.col("again"), 1).otherwise(0))
    return copies.select("key", "size", "pattern", taken.cast("long").alias("taken"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS k, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
z AS (SELECT k, source, sum(size)::BIGINT AS total FROM d GROUP BY k, source),
w AS (SELECT k, total, 2.0::DOUBLE * total AS cap, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM z),
v AS (SELECT *, (1.5::DOUBLE * sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
l AS (SELECT max(level) FILTER (cap / w > level) AS level FROM v),
t AS (SELECT k, total, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, l.level * w) END AS target FROM v, l),
q AS (SELECT *, floor(target)::BIGINT AS quota, CASE WHEN total = 0 THEN 0 ELSE floor(target)::BIGINT // total END AS laps FROM t),
o AS (SELECT d.*, total, target, laps, quota - laps * total AS rest, md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || size) AS o FROM d JOIN q USING (k)),
c AS (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS fits FROM o),
g AS (SELECT k, max(rest) - coalesce(sum(size) FILTER (fits), 0) AS gap FROM c GROUP BY k),
f AS (SELECT c.*, gap, CASE WHEN NOT fits AND size > 0 AND abs(size - gap) < gap THEN row_number() OVER (PARTITION BY c.k, NOT fits AND size > 0 ORDER BY abs(size - gap), o, doc_id) END AS best
  FROM c JOIN g ON c.k = g.k)
SELECT doc_id, size, total AS source_size, target, (size * (laps + CASE WHEN fits OR best = 1 THEN 1 ELSE 0 END))::BIGINT AS taken FROM f
"""
