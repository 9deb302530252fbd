"""Queries over whole tables: rows that a filter once kept from the operator."""

import hashlib
import json
import random

import pytest

import __spark_entry__
from paperloom.operators import layout, linkage, metrics
from paperloom.sources import feed

QUERIES = __spark_entry__.queries()


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_text_is_masked_and_restored(spark, tmp_path):
    texts = {1: "a `b` and $x$", 7: "costs $5", 10: "plain", 13: "", 14: None}
    sf = saved(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.same) for r in QUERIES["mask_round_trip"](spark, sf).collect()}
    assert got == {k: (v, True) for k, v in texts.items() if v is not None}


def test_sizes_and_favourites_of_every_customer(spark, tmp_path):
    sf = saved(spark, tmp_path, "customer", [(1, 3), (5, 3), (33, 3), (19_999, 4), (32_768, 4), (40_000, 4)], "c_custkey long, c_nationkey int")
    assert {r.c_custkey: r.size for r in QUERIES["size_format"](spark, sf).collect()} == {
        1: "1 B", 5: "25 B", 33: "1.1 KB", 19_999: "381.4 MB", 32_768: "1.00 GB", 40_000: "1.49 GB"}
    listed = {r.favourite: (r.n_docs, r.docs) for r in QUERIES["favorites_listing"](spark, sf).collect()}
    assert listed == {3: (3, "1,5,33"), 4: (3, "19999,32768,40000")}


def test_paragraphs_of_hard_texts(spark, tmp_path):
    texts = {1: "one\n\ntwo", 2: "a\n\n```\ncode\n\nmore\n```\n\nb", 3: "a\n\n$$\nx\n\ny\n$$\n\nb", 4: "a\n\n| x |\n|---|\n| 1 |", 5: "a\n\n~~~\ncode\n~~~", 6: "", 7: None}
    sf = saved(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    last = len("Second 1")
    got = {r.doc_id: (r.n, r.chars) for r in QUERIES["paragraph_counts"](spark, sf).collect()}
    assert got == {1: (3, 6 + last), 2: (3, 2 + last), 3: (3, 2 + last), 4: (2, 1 + last), 5: (2, 1 + last), 6: (1, last)}


def test_back_matter_of_short_texts(spark, tmp_path):
    texts = {k: "x" * n for k, n in ((0, 0), (1, 0), (3, 5), (4, 5), (7, 40), (9, 200), (10, 200), (13, 201), (2, 90))} | {6: None}
    sf = saved(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    want = {}
    for k, text in texts.items():
        if text is None or k % 3 == 2:
            continue
        head = f"# Title {k}\n\n{text}\n\n"
        size = len(head) + len(("## References" if k % 3 == 0 else "## 5. Funding statement") + f"\nItem {k}")
        if k % 3 == 0 or len(head) >= size // 2:
            want[k] = ("references" if k % 3 == 0 else "funding", f"Item {k}")
    got = {r.doc_id: (r.section, r.content) for r in QUERIES["back_matter_sections"](spark, sf).collect()}
    assert got == want and {0, 3, 9} < set(got) and 1 not in got


def test_messages_with_outer_space(spark, tmp_path):
    texts = {1: "plain", 2: "  two\nlines \n", 3: "\u3000wide", 4: " \n", 5: None}
    sf = saved(spark, tmp_path, "conversations", [(1, k, v) for k, v in texts.items()], "conv_id long, turn int, text string")
    quote = {1: "> plain\n\n", 2: "> two\n> lines\n\n", 3: "> wide\n\n", 4: "", 5: ""}
    got = {r.turn: r.message for r in QUERIES["chat_compose"](spark, sf).collect()}
    assert got == {k: f"see https://x.org\n\n{quote[k]}Why {k}?" for k in texts}
    placed = {r.paragraph: r["at"] for r in QUERIES["fuzzy_places"](spark, sf).collect()}
    assert placed == {1: -1, 2: -1, 3: -1, 4: -1}


def test_secrets_in_texts_are_redacted(spark, tmp_path):
    sf = saved(spark, tmp_path, "documents", [(1, "x password: hunter2 at /home/ann/f"), (2, "none"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in QUERIES["redact_text"](spark, sf).collect()}
    more = " api_key = [REDACTED]; Bearer [REDACTED] in <USER_HOME>/f"
    assert got == {1: f"x password: [REDACTED] at <USER_HOME>/f{more}", 2: f"none{more}", 3: None}


IMPORT = "id string, title string, authors array<string>, year string, doi string, ordinal long"


def in_order(incoming):
    keys = linkage.keyed(incoming).select("id", "ordinal", "doi_key", "title_key", "year_key", "author_key").orderBy("ordinal").collect()
    return sorted((i, accepted, target) for _, i, accepted, target in linkage._fold([r.asDict() for r in keys]))


def test_import_fold_of_a_long_chain(spark):
    """A thousand records linked alternately by DOI and title, a duplicate of the first at the end, and an id that repeats."""
    rows = [(f"r{n}", f"t{(n + 1) // 2}", [], "2000", f"10.1/{n // 2}", n) for n in range(1000)] + [("late", "other", [], "1", "10.1/0", 1000), ("r5", "x", [], None, None, 1001)]
    incoming = spark.createDataFrame(rows, IMPORT)
    got = sorted(tuple(r) for r in linkage.fold_import(incoming).collect())
    assert got == in_order(incoming) and ("late", False, "r0") in got and got.count(("r5", True, "r5")) == 1
    assert [g for g in got if g[0] == "r7"] == [("r7", False, "r6")]


@pytest.mark.parametrize(("seed", "most"), [(3, 100_000), (4, 5)])
def test_import_fold_is_the_fold_of_all_rows(spark, seed, most):
    """Random graphs; with a tiny group size large components are thinned out in rounds first."""
    rng = random.Random(seed)
    rows = [(f"r{n}", rng.choice(["t", "t", "u", "v", None]), [rng.choice("abcdefgh")] if rng.random() < 0.6 else [], rng.choice(["1", "2", "3", "4", None]), rng.choice([None, None, *map(str, range(40))]), n) for n in range(200)]
    incoming = spark.createDataFrame(rows, IMPORT)
    assert sorted(tuple(r) for r in linkage.fold_import(incoming, most).collect()) == in_order(incoming)


def test_fingerprint_gathers_no_key(spark):
    rows = [("hot", f"line {n % 1500} é") for n in range(3000)] + [("a", "x"), ("a", None), (None, "y"), ("none", None)]
    out = metrics.fingerprint(spark.createDataFrame(rows, "k string, line string").repartition(5), "k", "line")
    want = {k: hashlib.sha256("\n".join(sorted(v for key, v in rows if key == k and v is not None)).encode()).hexdigest() for k in ("hot", "a", None, "none")}
    assert {r.k: r.fingerprint for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_feed_has_a_partition_for_each_file(tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.jsonl").write_text("".join(json.dumps({"key": f"{n}{v}", "version": n * 2 + v, "body": "a\u2028b"}, ensure_ascii=False) + "\n" for v in (1, 2)), "utf-8")
    reader = feed.ItemFeed({"path": f"file://{tmp_path}", "since": "1"}).streamReader(None)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert (start, end, len(parts)) == ({"version": 1}, {"version": 6}, 3)
    assert sorted(r[1] for p in parts for r in reader.read(p)) == [2, 3, 4, 5, 6]


def test_clusters_of_a_long_chain(spark):
    order = [2, *range(10, 31), 1]
    rows = [(1, 1, block, "image", n * 180.0, 0.0, n * 180.0 + 100, 10.0) for n, block in enumerate(order)]
    blocks = spark.createDataFrame([*rows], "doc int, page int, block int, label string, left double, top double, right double, bottom double")
    assert {(r.block, r.cluster) for r in layout.clusters(blocks).collect()} == {(b, 1) for b in order}
