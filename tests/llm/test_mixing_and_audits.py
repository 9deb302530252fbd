"""Spelling variants, mixtures and filter audits against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import filter_audit, mixing, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Spelling variants ----------------------------------------------------------------------------------------------------


def counted(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near_words(words):
    near, masked = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
            masked[i, shorter].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    return near


def formed(counts, ratio=10):
    near, form = near_words(set(counts)), {}
    for w, n in counts.items():
        if near[w] and counts[best := min(near[w], key=lambda x: (-counts[x], x))] >= ratio * n:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_variants_of_odd_documents(spark, odd, odd_rows, empty):
    got = rows_of(spelling.spelling_variants(odd))
    assert got == formed(counted([(r[0], r[1]) for r in odd_rows])) and got
    assert rows_of(spelling.spelling_variants(empty)) == set()


def test_variants_of_dense_vocabularies(spark):
    """Nearly all words of tiny alphabets: every node has many branches, and runs of one character are everywhere."""
    rng = random.Random(6)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(80)} | {"".join(rng.choice("aÿc😀") for _ in range(rng.randint(0, 4))) for _ in range(120)}
    counts = {w: 10 ** rng.randint(0, 5) for w in sorted(words)}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_of(spelling.variants(vocabulary)) == formed(counts)


def test_variants_along_chains_and_of_very_long_words(spark):
    counts = {"a" * k + "b" * (9 - k): 10**k for k in range(9)} | {"x" * 30_000: 5, "x" * 29_999: 500, "x" * 15_000 + "y" + "x" * 14_999: 50_000}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = rows_of(spelling.variants(vocabulary))
    assert {(w, f, r, n) for w, f, r, n, *_ in got if len(w) < 20} == {(w, f, r, n) for w, f, r, n, *_ in formed({w: n for w, n in counts.items() if len(w) < 20})}
    assert {(len(w), n_near, r == "x" * 15_000 + "y" + "x" * 14_999) for w, _, r, _, n_near, _ in got if len(w) > 20} == {(30_000, 2, True), (29_999, 2, True)} | {(30_000, 2, True)}


def test_light_words_are_few(spark):
    """A word is light at no more nodes than the logarithm of the number of words."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(7, 12))) for _ in range(3000)}
    vocabulary = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    most = spelling.light_rows(vocabulary).groupBy("id").count().agg(F.max("count")).first()[0]
    assert 1 <= most <= len(words).bit_length()


# Mixtures -------------------------------------------------------------------------------------------------------------


def cheapest(sizes, members, quotas, costs):
    """(flow, cost) by one unit at a time along a cheapest way that Bellman and Ford find."""
    n, m = len(sizes), len(quotas)
    source, sink = n + m, n + m + 1
    arcs = []
    for p in range(n):
        for c in costs:
            arcs.append([source, p, sizes[p], c])
        for s in members[p]:
            arcs.append([p, n + s, 10**9, 0])
    for s in range(m):
        arcs.append([n + s, sink, quotas[s], 0])
    arcs = [a for x in arcs for a in (x, [x[1], x[0], 0, -x[3]])]
    flow = cost = 0
    while True:
        best, by = {source: 0}, {}
        for _ in range(n + m + 2):
            for i, (a, b, room, c) in enumerate(arcs):
                if room and a in best and best[a] + c < best.get(b, 10**9):
                    best[b], by[b] = best[a] + c, i
        if sink not in best:
            return flow, cost
        at = sink
        while at != source:
            i = by[at]
            arcs[i][2] -= 1
            arcs[i ^ 1][2] += 1
            at = arcs[i][0]
        flow, cost = flow + 1, cost + best[sink]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.sets(st.integers(0, 2))), min_size=1, max_size=5), st.lists(st.integers(0, 12), min_size=3, max_size=3))
def test_flow_is_of_least_cost(patterns, quotas):
    sizes, members = [s for s, _ in patterns], [sorted(m) for _, m in patterns]
    costs = (0, 1, 3)
    ways = mixing.routed(sizes, members, quotas, costs)
    assert all(set(w) <= set(m) for w, m in zip(ways, members, strict=True))
    assert all(sum(w.get(s, 0) for w in ways) <= q for s, q in enumerate(quotas))
    totals = [sum(w.values()) for w in ways]
    assert all(t <= 3 * s for t, s in zip(totals, sizes, strict=True))
    cost = sum(c * min(max(t - k * s, 0), s) for t, s in zip(totals, sizes, strict=True) for k, c in enumerate(costs))
    assert (sum(totals), cost) == cheapest(sizes, members, quotas, costs)


def test_targets():
    assert mixing.filled([100, 100, 100], (3, 1, 2), 450, 2.0) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.filled([10, 1000], (1, 1), 1515, 2.0) == [20, 1495] and mixing.filled([0, 0], (3, 1), 0, 2.0) == [0, 0] and mixing.filled([5], (1,), 100, 2.0) == [10]


def test_mixture_of_overlapping_sources(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice([["a"], ["b", "a"], ["b"], ["a", "b", "a"], [None, "b"], [], None])) for i in range(3000)] + [(7, "w " * 9, ["a"])] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<string>").repartition(3)
    first, again = (mixing.mix(docs, F.col("s"), {"a": 5, "b": 1, None: 2}, share=1.3) for _ in range(2))
    got = sorted(map(tuple, first.documents.collect()))
    assert got == sorted(map(tuple, again.documents.repartition(5).collect()))
    sizes = Counter((i, len(t.split()), None if s is None else tuple(sorted(set(s), key=str))) for i, t, s in rows)
    assert len(got) == len(rows) and Counter(r[0] for r in got) == Counter(r[0] for r in rows) and sum(sizes.values()) == len(got)
    assert all(t in (0, size, 2 * size) for _, size, _, t in got) and all(t == 0 for _, _, p, t in got if p == "[]")
    by_pattern = defaultdict(int)
    for _, _, p, t in got:
        by_pattern[p] += t
    for p in first.patterns:
        assert abs(by_pattern[p["pattern"]] - p["laps"] * p["total"] - p["rest"]) <= 2
    assert all(abs(s["routed"] - s["target"]) < 1 for s in first.sources)
    # Nothing is taken a second time while a pattern that could stand in for it has not been taken once.
    laps = {p["pattern"]: (p["laps"], p["rest"], p["total"]) for p in first.patterns if p["total"]}
    if any(n >= 1 and rest for n, rest, _ in laps.values()):
        assert all(n >= 1 for p, (n, _, _) in laps.items() if '"a"' in p)


def test_mixture_of_odd_documents(spark, odd, odd_rows, empty):
    got = mixing.mix(odd, F.array("source"), (3, 1, 2)).documents.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in odd_rows)
    assert mixing.mix(empty, F.array("source"), (3, 1, 2)).documents.count() == 0


# Filter audits --------------------------------------------------------------------------------------------------------


def audited(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    docs = []
    for d, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((part or "", {f for f, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in every)
                shapley[part, f] += len(gone)
                out.append((part, order, step, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_of_odd_documents(spark, odd, odd_rows, empty):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (8, None, 1), (11, 0, 1), (None, 1, 1), (99, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(r[0], r[1], r[2]) for r in odd_rows] + [(None, odd_rows[0][1], None), (0, "", None), (14, "a # B " * 200, None)] * 2
    extra = spark.createDataFrame(rows[len(odd_rows):], "doc_id long, text string, lang string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    got = filter_audit.interactions(docs, told)
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert filter_audit.interactions(empty, told).count() == 0


def test_zeta_and_chosen_orders(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 5, 2, 0, 1), ("p", 2, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = [tuple(r)[:6] for r in filter_audit.audit(counts, "xyz", ["zx", "y"]).orderBy("filter_order", "step").collect()]
    assert got == [("p", "y", 1, 7, 1, 0), ("p", "zx", 1, 6, 2, 0), ("p", "zx", 2, 6, 0, 2)]
