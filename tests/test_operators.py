"""Operators on small rows whose results are known."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.operators import documents, history, layout, linkage, merge, metrics, search, store
from paperloom.sources import records, snapshots
from paperloom.streaming import views

DOC = "id string, title string, authors array<string>, journal string, year string, doi string, keywords array<string>"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, a, None, y, d, []) for i, t, a, y, d in rows], DOC)


def test_duplicate_rule(spark):
    old = docs(spark, ("a", "One", ["X"], "2000", "10.1/A"), ("b", "Two", ["Y"], "2001", " "), ("c", "Three", ["Z"], None, None), ("d", "Four", [], "1999", "10.4/d"))
    new = docs(spark, ("1", "other", [], None, "10.1/a"), ("2", " two ", ["Q"], "2001", "10.9/x"), ("3", "THREE", ["z"], "1990", None), ("4", "Four", [], "1999", "10.5/e"), ("5", "One", [], "1777", None))
    assert {r.id: r.duplicate_of for r in linkage.duplicates(old, new).collect()} == {"1": "a", "2": "b", "3": "c"}
    how = {r.old: (r.new, r.how) for r in linkage.backup_id_map(old, new).collect()}
    assert how == {"1": ("a", "doi"), "2": ("b", "title"), "3": ("c", "title"), "4": ("d", "title"), "5": ("5", "added")}


def test_import_fold_is_in_order(spark):
    rows = docs(spark, ("a", "T", ["X"], "2000", None), ("b", "T", ["X"], "2001", "10.1/b"), ("c", "T", ["Y"], "2001", None), ("d", "U", [], None, "10.1/B"), ("e", "V", [], None, None))
    rows = rows.withColumn("ordinal", F.expr("instr('abcde', id)"))
    got = {r.id: (r.accepted, r.target) for r in linkage.fold_import(rows).collect()}
    assert got == {"a": (True, "a"), "b": (False, "a"), "c": (True, "c"), "d": (True, "d"), "e": (True, "e")}


def test_merges(spark):
    current = docs(spark, ("1", "mine", ["A"], "2000", None), ("2", "old", [], None, None))
    incoming = docs(spark, ("1", "new", ["B"], "2002", "10.1/x"), ("2", "new2", ["C"], "2003", None))
    previous = docs(spark, ("1", "source", ["A"], "2000", None))
    got = {r.id: r for r in linkage.merge_from_source(current, incoming, previous, "id", linkage.FIELDS).collect()}
    assert (got["1"].title, got["1"].authors, got["1"].year, got["1"].doi) == ("mine", ["B"], "2002", "10.1/x")
    assert (got["2"].title, got["2"].authors, got["2"].year) == ("old", ["C"], "2003")
    filled = {r.id: r for r in linkage.enrich(current, incoming, "id", ("authors", "year", "doi")).collect()}
    assert (filled["1"].authors, filled["1"].doi, filled["2"].year) == (["A"], "10.1/x", "2003")
    id_map = spark.createDataFrame([("x", "1"), ("y", "1")], "old string, new string")
    live = spark.createDataFrame([("h1", "1", "{}")], "id string, docId string, anchor string")
    backup = spark.createDataFrame([("h1", "x", "{}"), ("h2", "y", "{}"), ("h3", "q", "{}")], live.schema)
    assert sorted(map(tuple, merge.highlights(live, backup, id_map).collect())) == [("h1", "1", "{}"), ("h2", "1", None)]
    assert merge.orphan_count(backup, id_map, "docId").first().orphans == 1
    versions = [spark.createDataFrame([(v,)], "value string") for v in ("7", "x")]
    assert merge.library_version(*versions).first().version == 7


def test_history(spark):
    kind = "doc long, opened_at timestamp, progress double"
    live = spark.createDataFrame([(1, datetime(2024, 1, 2), 0.1), (2, datetime(2024, 1, 2), 0.5), (3, datetime(2024, 1, 1), 0.0)], kind)
    backup = spark.createDataFrame([(11, datetime(2024, 1, 3), 0.0), (12, datetime(2024, 1, 2), 0.6), (13, datetime(2023, 1, 1), 0.9), (99, datetime(2025, 1, 1), 0.0)], kind)
    id_map = spark.createDataFrame([(11, 1), (12, 2), (13, 3)], "old long, new long")
    assert [(r.doc, r.progress, r.from_live) for r in history.merge(live, backup, id_map).collect()] == [(1, 0.0, False), (2, 0.6, False), (3, 0.0, True)]
    quirk = history.merge_by_live(live, backup.withColumn("ordinal", F.col("doc")), id_map)
    assert [(r.doc, r.progress) for r in quirk.collect()] == [(1, 0.0), (2, 0.6), (3, 0.0)]
    day = spark.createDataFrame([("2024-01-31",), ("2024-01-30",), ("2024-01-29",), ("2024-01-24",), ("2024-01-23",), ("2023-12-31",)], "d string")
    names = day.select(history.section(F.col("d").cast("timestamp"), F.lit("2024-01-30").cast("date")).alias("s"))
    assert [r.s for r in names.collect()] == ["today", "today", "yesterday", "thisWeek", "thisMonth", "2023-12"]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 3)], "id int, v string, ordinal int")
    assert sorted(map(tuple, store.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, store.insert_ignore(old, new.drop("ordinal").filter("v <> 'y'"), ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "z")]
    names = spark.createDataFrame([(f"backup-{n}.zip",) for n in range(5)] + [("other",)], "name string")
    assert {r.name for r in store.prune_names(names, "name", r"^backup-.*\.zip$").collect()} == {"backup-0.zip", "backup-1.zip"}
    side = {"documents": old, "settings": old}
    restored = store.restore(side, {"documents": old.limit(0), "settings": old.limit(0)}, "library")
    assert restored["documents"].count() == 0 and restored["settings"].count() == 2


def test_snapshots_are_published_whole(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert snapshots.current(spark, root) is None
    a = spark.range(3)
    assert snapshots.publish(spark, root, {"a": a, "b": a}) == 1
    assert snapshots.publish(spark, root, {"a": spark.range(5)}) == 2
    assert snapshots.read(spark, root, "a").count() == 5 and snapshots.read(spark, root, "b").count() == 3
    a.write.parquet(f"{root}/v=3/a")  # a crash before the pointer moved
    assert snapshots.current(spark, root)[0] == 2
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, "c")


def test_search(spark):
    rows = spark.createDataFrame([(1, "Deep 学习方法 models"), (2, "learning deep"), (3, "100% sure"), (4, None)], "id int, title string")
    index = search.inverted_index(rows, "id", "title")
    assert [r.id for r in search.match(index, "学习 deep").collect()] == [1]
    assert search.match(index, " ").count() == 0
    assert {r.id for r in search.like(rows, "0%s", ("title",)).collect()} == {3}
    assert search.like(rows, "0%sure", ("title",), escape_wildcards=True).count() == 0
    assert {(r.id, r.phase) for r in search.merged(search.match(index, "deep"), rows.select("id").filter("id < 3")).collect()} == {(1, 0), (2, 0)}
    assert [r.id for r in rows.filter(search.any_field("LEARN", ("title",))).collect()] == [2]


MD = "# A\n\nfirst para\nstill\n\n```\ncode\n\nmore\n```\n\n$$\nx\n\ny\n$$\n\n![i](u)\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- item\n\n> quote\n\n## References\n\n[1] One 2001.\n[2] Two\nlines 2002.\n\n### Next\n\nend"


def test_markdown_structure(spark):
    rows = spark.createDataFrame([(1, MD)], "id int, md string")
    found = documents.paragraphs(rows, "id", "md").orderBy("start").collect()
    assert [(r.kind, r.text) for r in found] == [("heading", "# A"), ("text", "first para\nstill"), ("list", "- item"), ("blockquote", "> quote"), ("heading", "## References"), ("text", "[1] One 2001.\n[2] Two\nlines 2002."), ("heading", "### Next"), ("text", "end")]
    assert all(MD[r.start : r.end] == r.text for r in found)
    (section,) = documents.back_matter(rows, "id", "md").collect()
    assert (section.section, MD[section.content_start : section.content_end]) == ("references", "[1] One 2001.\n[2] Two\nlines 2002.")
    assert [(r.number, r.text) for r in documents.references(rows, "id", "md").orderBy("number").collect()] == [(1, "One 2001."), (2, "Two lines 2002.")]
    assert documents.compact(rows, "id", "md").first().text == MD[: section.heading_start].replace("![i](u)", "")


@pytest.mark.parametrize(("at", "heading", "hit"), [(0.1, "References", True), (0.4, "Funding", False), (0.6, "3. Funding", True), (0.55, "Ethics statement", False), (0.7, "Ethics statement:", True)])
def test_back_matter_levels(spark, at, heading, hit):
    text = "x" * int(1000 * at) + f"\n## {heading}\nbody\n" + "y" * int(1000 * (1 - at))
    assert documents.back_matter(spark.createDataFrame([(1, text)], "id int, md string"), "id", "md").count() == int(hit)


def test_protected_spans_round_trip(spark):
    texts = ["a `b$c` d", r"\(x\) and \[y\]", "$x$ costs $5 and $10", "no", "", "⟪$a⟫b$", "$a$ [[m7]] $b$"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", documents.masked(F.col("t")).alias("m"))
    back = rows.select("t", "m.masked", "m.spans", documents.unmasked(F.regexp_replace("m.masked", r"\[\[m", "[[ m"), F.col("m.spans")).alias("back")).collect()
    assert {r.t: r.masked for r in back}["$x$ costs $5 and $10"] == "[[m0]] costs $5 and $10"
    assert all(r.back.replace("[[ m", "[[m") == r.t for r in back)


def test_tables(spark):
    html = "<table><tr><th rowspan=2>A</th><td colspan=2>b<br>c</td></tr><tr><td>1</td><td rowspan=0>2</td></tr></table><table><tr><td rowspan=3>x</td></tr></table>"
    rows = documents.html_tables(spark.createDataFrame([(1, html), (2, "none")], "id int, html string"), "id", "html").collect()
    assert [(r.row, r.column, r.row_span, r.column_span, r.text, r.header) for r in rows if r.table == 0] == [(0, 0, 2, 1, "A", True), (0, 1, 1, 2, "b\nc", False), (1, 1, 1, 1, "1", False), (1, 2, 1, 1, "2", False)]
    assert [(r.row, r.problem) for r in rows if r.table == 1] == [(None, "table_size")]
    md = spark.createDataFrame([("|a|b|\n|---|---|\n|1|x\\|y|",), ("|a|b|\n|---|---|\n|1|",), ("plain",)], "md string").select(documents.pipe_table(F.col("md")).alias("t"))
    assert [r.t for r in md.collect()] == [[["a", "b"], ["1", "x|y"]], None, None]


def test_reflow():
    assert documents.reflow("a line\nthat goes on\n\nEnd of page and\n\nnext page. \n\nNew one.") == "a line that goes on End of page and next page. \n\nNew one."
    assert documents.reflow("inter-\nnational\n# Head\n中文\n字") == "international\n# Head\n中文字"
    assert documents.reflow("```\na\nb\n```\ntext") == "```\na\nb\n```\ntext"


def test_title_filter(spark):
    md = "# Journal\n\n# Deep models of things\ntext"
    got = spark.createDataFrame([(md, "Deep models of thing"), (md, "Unrelated words here"), (md, "")], "md string, title string").select(documents.before_title_dropped(F.col("md"), F.col("title")).alias("v")).collect()
    assert [r.v for r in got] == [md[11:], md, md]


def test_page_chunks(spark):
    rows = spark.createDataFrame([(1, 720), (2, 200), (3, 201), (4, None), (5, 230)], "id int, n int")
    got = layout.page_chunks(rows, "n").orderBy("id", "index").collect()
    assert [(r.start_page, r.end_page) for r in got if r.id == 1] == [(1, 200), (201, 400), (401, 600), (601, 720)]
    assert [(r.id, r.start_page, r.end_page, r.whole_file) for r in got if r.id in (2, 4)] == [(2, 1, 200, True), (4, 0, 0, True)]
    assert [(r.start_page, r.end_page) for r in got if r.id == 5][-1] == (201, 230) and [(r.start_page, r.end_page) for r in got if r.id == 3][-1] == (201, 201)


def test_chunk_merge(spark):
    chunks = spark.createDataFrame([(1, 1, "PAGE_2 \n", "{}"), (1, 0, "PAGE_1", "{}"), (2, 0, None, "{}"), (3, 0, "x", "{}"), (3, 0, "y", "{}")], "doc int, index int, markdown string, layout string")
    assert {r.doc: r.markdown for r in layout.merged_markdown(chunks.filter("doc = 1"), "doc").collect()} == {1: "PAGE_1\n\nPAGE_2"}
    assert {(r.doc, r.problem) for r in layout.chunk_problems(chunks, "doc").collect()} == {(2, "no_markdown"), (3, "duplicate")}
    images = spark.createDataFrame([(1, 0, "images/fig.jpg", "a"), (1, 1, "images/fig.jpg", "b"), (1, 2, "images/fig.jpg", "a")], "doc int, index int, path string, digest string")
    assert {(r["index"], r.new_path) for r in layout.renamed_images(images, "doc").collect()} == {(0, "images/fig.jpg"), (1, "images/c1_fig.jpg"), (2, "images/fig.jpg")}


BLOCK = "doc int, page int, block int, label string, left double, top double, right double, bottom double, content string"


def test_captions(spark):
    def block(n, label, x, y, w=200, h=100, page=0):
        return (1, page, n, label, float(x), float(y), float(x + w), float(y + h), f"{label}{n}")

    rows = [block(1, "image", 50, 100), block(2, "figure_title", 50, 210, 200, 20), block(3, "image", 500, 600), block(4, "figure_title", 500, 710, 200, 20),
            block(5, "image", 50, 100, page=1), block(6, "image", 255, 100, page=1), block(7, "figure_title", 50, 205, 400, 20, page=1), block(8, "text", 50, 1000, 600, 20, page=1), block(9, "text", 50, 1000, 600, 20)]
    blocks = spark.createDataFrame(rows, BLOCK)
    groups = {(r.page, r.block): r.cluster for r in layout.clusters(blocks).collect()}
    assert groups == {(0, 1): 1, (0, 3): 3, (1, 5): 5, (1, 6): 5}
    captions = blocks.filter("label = 'figure_title'").withColumn("kind", F.lit("figure"))
    assert {(r.page, r.cluster, r.caption) for r in layout.caption_pairs(blocks, captions).collect()} == {(0, 1, 2), (0, 3, 4), (1, 5, 7)}


def test_columns(spark):
    def text(n, x, page):
        return (1, page, n, "text", float(x), 100.0 * n, x + 300.0, 100.0 * n + 80, "")

    rows = [text(n, 50 if n % 2 else 450, 0) for n in range(6)] + [text(n, 50 if n % 2 else 450, 1) for n in range(5)]
    assert {r.page: r.is_double for r in layout.columns(spark.createDataFrame(rows, BLOCK)).collect()} == {0: True, 1: False}


def test_fingerprints(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x")], "k int, line string")
    again = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y")], "k int, line string")
    a, b = ({r.k: r.fingerprint for r in metrics.fingerprint(x, "k", "line").collect()} for x in (rows, again))
    assert a[1] == b[1] and a[2] != b[2]


def test_record_readers(spark):
    crossref = '{"title":["T"],"container-title":["J"],"author":[{"given":"A","family":"B"},{"name":"Group"}],"DOI":"10.1234/x","published-online":{"date-parts":[[2001]]},"published-print":{"date-parts":[[1999,1]]}}'
    got = spark.createDataFrame([(crossref,), ("broken",)], "b string").select(records.crossref(F.col("b")).alias("r")).collect()
    assert tuple(got[0].r) == ("T", ["A B", "Group"], "J", "1999", "10.1234/x") and got[1].r.title is None
    xml = "<A><ArticleTitle>T</ArticleTitle><Author><LastName>L</LastName><ForeName>F</ForeName></Author><Journal><Title>J</Title></Journal><PubDate><MedlineDate>1998 Jan</MedlineDate></PubDate><ArticleId IdType='doi'>10.1234/y</ArticleId><Keyword>Cell</Keyword><Keyword>cell</Keyword></A>"
    (r,) = spark.createDataFrame([(xml,)], "b string").select(records.pubmed(F.col("b")).alias("r")).first()
    assert (r.title, r.authors, r.journal, r.year, r.doi, r.keywords) == ("T", ["F L"], "J", "1998", "10.1234/y", ["Cell"])


def test_ocr_pages_in_three_shapes(spark):
    page = '{"page_index":7,"markdown":{"text":"M","images":{}},"prunedResult":{"parsing_res_list":[{"block_id":"1","block_label":"text","block_bbox":[0,0,2,1],"block_content":"c"}]}}'
    layout_json = '{"pdf_info":[{"page_idx":0,"page_size":[612,792],"para_blocks":[{"type":"title","bbox":[1,2,3,4],"lines":[{"bbox":[1,2,3,4],"spans":[{"type":"text","content":"H"}]}]}]}]}'
    rows = spark.createDataFrame([(1, f"[{page},{page}]"), (2, f'{{"layoutParsingResults":[{page}]}}'), (3, layout_json), (4, "nonsense")], "id int, body string")
    pages = records.ocr_pages(rows, "id", "body")
    assert sorted((r.id, r.page) for r in pages.collect()) == [(1, 0), (1, 1), (2, 0), (3, 0)]
    found = {r.doc: (r.label, r.content, r.right) for r in records.blocks(pages, "id").collect()}
    assert found[3] == ("paragraph_title", "H", 6.0) and found[2] == ("text", "c", 2.0)


def test_streams_equal_their_batches(spark, tmp_path):
    rows = spark.createDataFrame([(k, n, 0.1 * (n // 3), f"d{n};") for k in (1, 2) for n in range(12)], "k int, n int, v double, d string")
    for part in range(3):
        rows.filter(f"n >= {part * 4} AND n < {part * 4 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(stream, mode, name):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    source = views.watch(spark, str(tmp_path / "in"), "k int, n int, v double, d string")
    folded = run(views.folded_stream(source, "k", "n", "d"), "update", "folded").groupBy("k").agg(F.max_by("text", "n_deltas").alias("text"))
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, views.folded(rows, "k", "n", "d").select("k", "text").collect()))
    kept = run(views.changes_stream(source, "k", "n", "v", 0.05), "append", "kept")
    assert sorted(map(tuple, kept.select("k", "n").collect())) == sorted(map(tuple, views.changes(rows, "k", ["n"], "v", 0.05).select("k", "n").collect()))


def test_activity_and_events(spark):
    body = 'data: {"a":1}\n\ndata: [DONE]\n\ndata: {broken\n\nevent: x\ndata: {"b":\ndata: 2}\n\n'
    assert [r.data for r in views.sse_deltas(spark.createDataFrame([(body,)], "value string")).collect()] == ['{"a":1}', '{"b":\n2}']
    events = [(1, 1, "reasoning", None, None, "think"), (1, 2, "reasoning", None, None, "ing"), (1, 3, "tool", "t1", "running", ""), (1, 4, "text", None, None, "hi"), (1, 5, "tool", "t2", "completed", ""), (1, 6, "status", None, "failed", "")]
    steps = views.activity_steps(spark.createDataFrame(events, "session int, ordinal int, kind string, id string, status string, text string")).orderBy("step").collect()
    assert [(s.kind, s.status, s.text) for s in steps] == [("reasoning", "completed", "thinking"), ("tool", "failed", ""), ("tool", "completed", "")]
    writes = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, request int, text string")
    assert {r.text: r.superseded for r in views.newest_write(writes, "key", "request").collect()} == {"old": True, "new": False}


def test_anchors(spark):
    from paperloom.operators import reader

    text = "one two three two one"
    cases = [("r", 4, 7, "two", "", "", (4, 7)), ("old", 4, 7, "two", "one ", "", (4, 7)), ("old", 0, 3, "two", "", "", None), ("r", 0, 3, "two", "three ", " one", (14, 17)), ("r", 0, 0, "", "", "", None)]
    rows = spark.createDataFrame([(text, c[:6]) for c in cases], "t string, a struct<revision:string,start:int,end:int,quote:string,prefix:string,suffix:string>")
    got = rows.select(reader.resolved(F.col("t"), F.lit("r"), F.col("a")).alias("v")).collect()
    assert [tuple(r.v) if r.v else None for r in got] == [c[6] for c in cases]
    needle = spark.createDataFrame([("xx the quick brown fox", "quick brawn"), ("nothing alike", "zzzzzz")], "t string, n string")
    assert [r.v for r in needle.select(reader.fuzzy_place(F.col("t"), F.col("n")).alias("v")).collect()] == [7, -1]


def test_library_items(spark):
    items = [
        '{"key":"A","version":3,"data":{"itemType":"journalArticle","title":" T ","creators":[{"creatorType":"editor","name":"E"},{"creatorType":"author","firstName":"F","lastName":"L"}],"publicationTitle":"J","date":"May 2001","DOI":"10.1234/X","tags":[{"tag":"a"},{"tag":"A"},{"tag":" "}]}}',
        '{"key":"P","version":4,"data":{"itemType":"attachment","contentType":"application/pdf","linkMode":"imported_file","parentItem":"A"}}',
        '{"key":"B","version":5,"data":{"itemType":"book","title":"Only a title"}}', '{"key":"C","version":5,"data":{"itemType":"book","title":"Gone","deleted":1,"ISBN":"1"}}', "broken"]
    (row,) = records.library_items(spark.createDataFrame([(i,) for i in items], "b string"), "b").collect()
    assert (row.key, row.title, row.authors, row.journal, row.year, row.doi, row.keywords, row.pdfs) == ("A", "T", ["F L"], "J", "2001", "10.1234/x", ["a"], ["P"])


def test_item_feed(spark, tmp_path):
    from paperloom.sources.feed import ItemFeed

    spark.dataSource.register(ItemFeed)
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"key":"x","version":1,"body":"b"}\n{"key":"y","version":5,"body":null}\n')
    source = f"file://{folder}"
    assert {r.key for r in spark.read.format("item_feed").option("since", 1).load(source).collect()} == {"y"}
    for _ in range(2):
        stream = spark.readStream.format("item_feed").load(source)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start(str(tmp_path / "o")).awaitTermination()
        (folder / "b.jsonl").write_text('{"key":"z","version":9,"body":""}\n')
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["x", "y", "z"]


def test_markdown_cleanup(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    assert value(documents.equations_promoted(F.lit("a\n $x=1$ \n$y$\nb $z=2$"))) == "a\n\n$$\nx=1\n$$\n\n$y$\nb $z=2$"
    assert value(documents.centred_divs_unwrapped(F.lit('<div style="text-align: center;">Note</div>x<div style="text-align:center;"> (a) </div><div style="text-align: center;"><img src="u"></div>'))) == '*Note*x(a)<img src="u">'
    assert value(documents.formulas_spaced(F.lit("a $ x + 1 $ b"))) == "a $x + 1$ b"


def test_xmp_and_citation_urls(spark):
    packet = "junk<x:xmpmeta xmlns:x='x' xmlns:dc='d' xmlns:p='p' xmlns:r='r'><dc:title><r:Alt><r:li>A  title</r:li></r:Alt></dc:title><dc:creator><r:Seq><r:li>B</r:li><r:li>C</r:li></r:Seq></dc:creator><p:doi>doi:10.1234/z</p:doi><p:coverDate>12 May 2003</p:coverDate></x:xmpmeta>"
    got = spark.createDataFrame([(packet,), ("2001 no packet 10.1234/q",)], "b string").select(records.xmp(F.col("b")).alias("r")).collect()
    assert tuple(got[0].r) == ("A title", ["B", "C"], None, "2003", "10.1234/z") and (got[1].r.title, got[1].r.year, got[1].r.doi) == (None, "2001", "10.1234/q")
    cases = [("<meta name=citation_pdf_url content='/a.pdf?x=1&amp;y'>", "https://h.org/p/q", "https://h.org/a.pdf?x=1&y"), ('<META content="b.pdf" NAME="Citation_PDF_URL">', "http://h.org/p/q?z", "http://h.org/p/b.pdf"),
             ('<meta name="citation_pdf_url" content="ftp://x/y">', "http://h.org", None), ('<meta name="other" content="u">', "http://h.org", None)]
    rows = spark.createDataFrame([c[:2] for c in cases], "h string, u string").select(records.citation_pdf_url(F.col("h"), F.col("u")).alias("v")).collect()
    assert [r.v for r in rows] == [c[2] for c in cases]
    blocks = spark.createDataFrame([(1, 0, 1, "doc_title", " "), (1, 0, 2, "doc_title", "Journal\n深度学习方法\n研究方法"), (2, 0, 1, "doc_title", "A\nB")], "doc int, page int, block int, label string, content string")
    assert {r.doc: r.title for r in layout.document_titles(blocks).collect()} == {1: "深度学习方法", 2: "A"}
