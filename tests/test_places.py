"""Places in texts: against plain Python, and in time that grows with the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from paperloom.functions import places as P
from paperloom.functions import text as T
from paperloom.operators import captions, documents

RANGES = "array<struct<start: int, end: int>>"


def test_placed_and_pieces(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1\n 😀é") for _ in range(rng.choice([0, 1, 5, 50, 3000]))) for _ in range(60)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", P.placed(F.col("t"), "[0-9]+", around=True).alias("p"), P.pieces(F.col("t"), "\n").alias("q")).collect():
        if r.t is None:
            assert r.p is None and r.q is None
            continue
        assert [(x.start, x.end, x.value) for x in r.p] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", r.t)]
        gaps = re.split("[0-9]+", r.t)
        assert [(x.before, x.after) for x in r.p] == list(zip(gaps, gaps[1:], strict=False))
        at, want = 0, []
        for line in r.t.split("\n"):
            want.append((at, at + len(line), line))
            at += len(line) + 1
        assert [tuple(x) for x in r.q] == want


def _apart(rng, n):
    points = sorted(rng.sample(range(n * 6), n * 2)) if n else []
    return list(zip(points[::2], points[1::2], strict=True))


def test_overlaps_and_replaced(spark):
    rng = random.Random(2)
    rows = [(i, *(_apart(rng, rng.choice([0, 1, 5, 200])) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, f"i int, items {RANGES}, a {RANGES}, b {RANGES}")
    for r in df.select("i", P.overlaps(F.col("items"), [F.col("a"), F.col("b")]).alias("o")).collect():
        _, items, a, b = rows[r.i]
        for (x, y), got in zip(items, r.o, strict=True):
            want = sorted((u, layer) for layer, ranges in enumerate((a, b)) for u, v in ranges if u < y and v > x)
            assert (tuple(got) if got else None) == (want[0] if want else None)
    texts = ["".join(rng.choice("abcé😀") for _ in range(2500)) for _ in range(30)]
    rows = [(i, t, sorted((k, k + rng.randint(1, 30)) for k in (rng.randint(0, 2460) for _ in range(rng.choice([0, 1, 5, 300]))))) for i, t in enumerate(texts)]
    for r in spark.createDataFrame(rows, f"i int, t string, r {RANGES}").select("t", "r", P.replaced(F.col("t"), F.col("r"), lambda x: F.concat(F.lit("<"), x["start"].cast("string"), F.lit(">"))).alias("o")).collect():
        out, upto = "", 0
        for x in r.r:
            out += r.t[upto : x.start] + f"<{x.start}>" if x.start >= upto else ""
            upto = max(upto, x.end)
        assert out + r.t[upto:] == r.o


@pytest.mark.parametrize("name", ["lines", "paragraphs", "headings", "find", "hits", "captions"])
def test_a_text_full_of_matches_takes_time_by_its_length(spark, name):
    """1 MB and 2 MB full of what is looked for: at most three times the time (and a second for noise)."""
    unit = {"lines": "a line of words\n", "paragraphs": "some words\n\n$$x$$\n\n", "headings": "## References\n\nwords\n", "find": "word \n", "hits": "a word ", "captions": "Figure 1. Words.\n"}[name]

    def run(size):
        text = unit * (size // len(unit)) + "the end"
        docs = spark.createDataFrame([(1, text)], "id int, t string").cache()
        docs.count()
        began = time.perf_counter()
        out = {"lines": lambda: documents.lines(docs, "id", "t"), "paragraphs": lambda: documents.paragraphs(docs, "id", "t"), "headings": lambda: documents.back_matter(docs, "id", "t"),
               "find": lambda: docs.select(T.find_in_text(F.col("t"), F.lit("word the  end")).alias("p")).filter("p.start > 0"),
               "hits": lambda: docs.select(F.explode(T.search_hits(F.col("t"), "word"))), "captions": lambda: docs.select(F.explode(captions.ranges(F.col("t"), F.lit(False))))}[name]().count()
        return out, time.perf_counter() - began

    run(10_000)
    (n1, one), (n2, two) = run(1_000_000), run(2_000_000)
    assert n2 == (1 if name == "find" else pytest.approx(2 * n1, rel=0.01)) and n1 > 0
    assert two < 3 * one + 1, (one, two)
    print(name, round(one, 1), round(two, 1))
