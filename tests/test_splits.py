"""Blocks cut at captions: known cases."""

from paperloom.operators import splits


def test_cuts(spark):
    blocks = spark.createDataFrame([("d", 1, "a", "text", "Before. Figure 1. It  then more"), ("d", 1, "b", "text", "Figure 2. All"), ("d", 1, "c", "text", None), ("d", 2, "a", "text", "x y z")], "doc string, page int, block string, label string, content string")
    refs = [("d", 1, "a", 8, 20, "Figure 1. It"), ("d", 1, "a", 8, 20, "Figure 1. It"), ("d", 1, "a", 15, 24, "1. It  th"), ("d", 1, "a", 22, 26, "wrong"), ("d", 1, "b", 0, 13, "Figure 2. All"), ("d", 1, "c", 0, 1, "x"), ("d", 2, "a", 4, 9, "z"), ("d", 9, "a", 0, 1, "x")]
    refs = spark.createDataFrame(refs, "doc string, page int, block string, start int, end int, text string")
    got = sorted(tuple(r[c] for c in ("page", "block", "part", "part_id", "label", "content")) for r in splits.split_captions(blocks, refs).collect())
    assert got == [(1, "a", 0, "a:0", "text", "Before."), (1, "a", 1, "a:8", "figure_title", "Figure 1. It"), (1, "a", 2, "a:20", "text", "then more"), (1, "b", 0, None, "text", "Figure 2. All"), (1, "c", 0, None, "text", None), (2, "a", 0, None, "text", "x y z")]
    assert splits.split_captions(blocks.limit(0), refs).count() == 0 and splits.split_captions(blocks, refs.limit(0)).count() == 4
