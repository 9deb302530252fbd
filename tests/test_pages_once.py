"""Pages of blocks are dealt out once, and what is found on a page stays with it."""

import pytest

from paperloom.operators import captions, figures, layout
from paperloom.plans import figures as plans
from paperloom.plans import library
from paperloom.sources import scratch
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
BLOCK = "doc string, page int, block int, label string, content string, parent string, left double, top double, right double, bottom double"


@pytest.fixture()
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def further_shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_pages_with_figures_and_captions_move_once(unbroadcast):
    blocks, held = plans._blocks(unbroadcast, SF)
    assert further_shuffles(figures.pages(blocks, held)) == 0
    before = len(scratch._written)
    library.QUERIES["figure_assignments"](unbroadcast, SF)
    assert len(scratch._written) == before + 1, "pages are the one table that is written"


def test_caption_pairs_and_clusters_move_pages_once(unbroadcast):
    before = len(scratch._written)
    assert {name: further_shuffles(library.QUERIES[name](unbroadcast, SF)) for name in ("pair_captions", "cluster_boxes", "columns_detect")} == dict.fromkeys(("pair_captions", "cluster_boxes", "columns_detect"), 0)
    assert len(scratch._written) == before


def test_regions_move_pages_once(unbroadcast):
    assert further_shuffles(library.QUERIES["figure_regions"](unbroadcast, SF)) == 0


def test_a_repeated_block_counts_once(spark):
    rows = [("d", 1, 1, "image", "", None, 50.0, 100.0, 450.0, 300.0)] * 2 + [("d", 1, 2, "figure_title", "Figure 1. It", None, 50.0, 310.0, 450.0, 330.0)]
    blocks = spark.createDataFrame(rows, BLOCK)
    held = blocks.filter("block = 2").withColumn("kind", F.lit("figure"))
    scores = [r.score for r in layout.caption_pairs(blocks, held).collect()]
    assert len(scores) == 1 and 3 < scores[0] < 4


def test_null_sides_and_pages(spark):
    rows = [("d", 1, 1, "image", "", None, None, 100.0, 450.0, 300.0), ("d", 1, 2, "image", "", None, 50.0, 100.0, 450.0, 300.0), (None, None, 1, "image", "", None, 0.0, 0.0, 9.0, 9.0), (None, None, 2, "image", "", None, 0.0, 0.0, 9.0, 9.0),
            ("e", 1, 1, None, None, None, 0.0, 0.0, 9.0, 9.0)]
    assert {(r.doc, r.block, r.cluster) for r in layout.clusters(spark.createDataFrame(rows, BLOCK)).collect()} >= {(None, 1, 1), (None, 2, 2)}


def test_many_lots_of_one_document():
    """A long chain of lots that meet at last, and thousands that never do."""
    rows = [{"doc": "d", "page": n, "caption": "a", "score": 3.0, "members": [f"{n}:x"]} for n in range(20_000)]
    rows += [{"doc": "d", "page": n, "caption": "b", "score": 1.0, "members": [f"{n}:x", f"{n + 1}:x"]} for n in range(0, 8, 2)]
    got = figures._chosen(rows)
    assert sorted(got) == [("d", n, "a", f"{n}:x") for n in range(20_000)]


def test_parts_and_beginnings(spark):
    texts = ["(a)", "a", " a, b ", "A and B", "(b).", "a&c", " x ", "K", "word", "ab", "(", "", None, "a band", "and", "a\n", "Figure 1. X", "Table 2", "表1 数", "  Fig. 3: y", "Scheme 4", "Figurine"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.lower(figures.T.strip(F.coalesce("t", F.lit("")))).rlike(figures.T.SUB_LABEL)
    for r in df.select("t", figures.is_part(F.col("t")).alias("a"), plain.alias("b"), captions.begins(F.col("t")).alias("c"), captions.kind_of(F.col("t")).isNotNull().alias("d")).collect():
        assert r.a == r.b and bool(r.c) == r.d, r.t
