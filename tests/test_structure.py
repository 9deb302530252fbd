"""Captions, pages, regions, places and LaTeX on small rows whose results are known."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import latex
from paperloom.functions import text as T
from paperloom.operators import captions, library, structure


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "plain"), [
    (r"a $\alpha_2+x^{2n}$ b", "a α₂+x²ⁿ b"), (r"$\mathrm{H}_2\mathrm{O}$", "H₂O"), (r"$\frac{a}{b}$", r"$\frac{a}{b}$"), ("${}^{3}$", "³"), (r"$\text{abc} $", "abc"), (r"$10^{-3}\%$", "10⁻³%"),
    (r"$\{x\}$", r"$\{x\}$"), (r"$\epsilonx$", r"$\epsilonx$"), ("costs $5", "costs $5"), ("$ x $", "x"), (r"$\mathbf{\mathrm{a}}$", "a")])
def test_inline_latex(text, plain):
    assert latex.simplified(text) == plain


def test_places(spark):
    assert tuple(value(spark, T.find_in_text(F.lit("one two\n\nthree"), F.lit("two three")))) == (4, 14)
    assert tuple(value(spark, T.find_in_text(F.lit("one two"), F.lit("two")))) == (4, 7)
    assert value(spark, T.find_in_text(F.lit("one two"), F.lit("four"))) is None
    assert tuple(value(spark, T.unique_place(F.lit("a  b\nc a b d"), F.lit("b c")))) == (3, 6)
    assert value(spark, T.unique_place(F.lit("a b a  b"), F.lit("a b"))) is None
    assert tuple(value(spark, T.segmented(F.lit("x y z"), F.lit("y")))) == ("x \n%%%%\ny\n%%%%\n z", 1)
    assert tuple(value(spark, T.parsed_segments(F.lit("X\n%%%%\nY \n%%%%\nZ"), F.lit(1)))) == ("XYZ", 1, 2)
    assert tuple(value(spark, T.parsed_segments(F.lit("X\n%%%%\nY"), F.lit(2)))) == ("XY", None, None)
    assert tuple(value(spark, T.parsed_segments(F.lit("X %%"), F.lit(1)))) == ("X ", None, None)


def test_search_and_copies(spark):
    hits = value(spark, T.search_hits(F.lit("A cat. Concat cat"), "cat", whole=True))
    assert [(h.start, h.length, h.match_start) for h in hits] == [(2, 3, 2), (14, 3, 14)] and hits[0].snippet == "A cat. Concat cat"
    assert value(spark, T.search_hits(F.lit("CAT (x)"), "(X)", case=True)) == [] and len(value(spark, T.search_hits(F.lit("CAT (x)"), "(X)"))) == 1
    assert value(spark, T.copy_text(F.lit("inter-\nnational law\nends\n\n\n中文\n字 \n\n "))) == "international law ends\n\n中文字"
    assert value(spark, T.plain_text(F.lit("# A **b** _c_\n\n- [t](u) ![i](v) `x` $a_b$\n\n| p | q |\n|---|---|\n| 1 | 2 |"))) == "A b c t x $a_b$ p q 1 2"


@pytest.mark.parametrize(("url", "pdf"), [
    ("https://arxiv.org/abs/2101.1", "https://arxiv.org/pdf/2101.1"), ("https://www.biorxiv.org/content/10.1101/2.1v2/", "https://www.biorxiv.org/content/10.1101/2.1v2.full.pdf"),
    ("https://link.springer.com/a", "https://link.springer.com/content/pdf/10.1/d.pdf"), ("https://pubs.rsc.org/en/content/articlelanding/x", "https://pubs.rsc.org/en/content/articlepdf/x"),
    ("https://www.sciencedirect.com/s/1?q=2", "https://www.sciencedirect.com/s/1/pdfft?download=true"), ("https://www.mdpi.com/1/2/", "https://www.mdpi.com/1/2/pdf"), ("https://example.org", None), ("no url", None)])
def test_publisher_urls(spark, url, pdf):
    assert value(spark, T.publisher_pdf_url(F.lit(url), F.lit("10.1/d"))) == pdf


def test_caption_patterns(spark):
    kinds = {"Figure 1. x": "figure", "Fig.2 x": "figure", "Figure: x": None, "FigS1 x": "figure", "Supplementary Table 2 x": "table", "Extended Data Fig. 3 |": "figure", "表 3 结果": "table", "补充图 1": "figure",
             "Scheme IV: x": "other", "Tableau 2 – y": "table", "Figures show": None, "Рис. 4. x": "figure"}
    rows = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", captions.kind_of(F.col("t")).alias("k"), captions.is_supplement(F.col("t")).alias("s")).collect()
    assert {r.t: r.k for r in rows} == kinds
    assert {r.t for r in rows if r.s} == {"Supplementary Table 2 x", "Extended Data Fig. 3 |", "补充图 1", "FigS1 x"}


def test_caption_ranges(spark):
    text = "Some text. Figure 1: one\nFigure 2. two\n\nmore as Figure 3 shows. Table 4: four"
    found = value(spark, captions.ranges(F.lit(text), F.lit(False)))
    assert [text[r.start : r.end] for r in found] == ["Figure 1: one\n", "Figure 2. two", "Table 4: four"]
    assert [tuple(r) for r in value(spark, captions.ranges(F.lit("Overview"), F.lit(True)))] == [(0, 8)]
    assert value(spark, captions.ranges(F.lit("(a)"), F.lit(True))) == []


def test_caption_candidates_continue(spark):
    rows = [(1, 0, 1, "text", "plain"), (1, 0, 2, "figure_title", "Figure 1. Begins"), (1, 0, 3, "figure_title", "and goes on"), (1, 0, 4, "figure_title", "further"), (1, 0, 5, "text", "Table 2. Own"), (1, 1, 1, "figure_title", "alone here")]
    got = captions.candidates(spark.createDataFrame(rows, "doc int, page int, block int, label string, content string")).collect()
    assert {(r.page, r.block): (r.text, r.kind) for r in got} == {(0, 2): ("Figure 1. Begins\nand goes on\nfurther", "figure"), (0, 5): ("Table 2. Own", "table"), (1, 1): ("alone here", "figure")}


def test_continued_figures(spark):
    kind = "doc int, entry long, page long, kind string, caption string, left double, right double, caption_ref string"
    rows = [(1, 1, 1, "table", "Table 2 x", 0.0, 100.0, "a"), (1, 2, 2, "table", "Table 2 (continued)", 5.0, 90.0, "b"), (1, 3, 3, "table", "Table 2 (continued)", 5.0, 90.0, "c"), (1, 4, 4, "table", "Table 3 (continued)", 5.0, 90.0, "d"),
            (1, 5, 9, "figure", "Figure 1", 0.0, 1.0, "f"), (1, 6, 9, "figure", "Figure 1", 50.0, 60.0, "f"), (2, 1, 2, "table", "Table 2 (continued)", 5.0, 90.0, "b")]
    got = {(r.doc, r.entry): r.figure for r in captions.continued(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 4, (1, 5): 5, (1, 6): 5, (2, 1): 1}


def test_pages_are_assembled(spark):
    rows = [(1, n, f"PAGE_{n + 1} ![](k)", {"k": "u" if n != 2 else "v"}) for n in range(720)]
    got = {r.page: r for r in structure.assembled_pages(spark.createDataFrame(rows, "doc int, ordinal int, markdown string, images map<string,string>")).collect()}
    assert [re.match(r"PAGE_(\d+)", got[n].markdown).group(1) for n in range(720)] == [str(n + 1) for n in range(720)]
    assert (got[2].markdown, got[2].images, got[3].images) == ("PAGE_3 ![](p2_k)", {"p2_k": "v"}, {"k": "u"})


def test_text_regions_of_groups(spark):
    kind = "doc int, page int, ordinal int, block string, label string, content string, global_group int, local_group int, left double, top double, right double, bottom double"
    box = (0.0, 0.0, 10.0)
    rows = [(1, 0, 1, "a", "text", "x" * 90, 7, 1, *box, 10.0), (1, 0, 2, "b", "text", "", 8, 1, *box, 20.0), (1, 1, 1, "c", "text", " ", 7, -1, *box, 30.0), (1, 0, 3, "d", "text", "two", 9, 2, *box, 5.0),
            (1, 0, 4, "e", "text", "three", 9, 2, *box, 5.0), (1, 0, 5, "t", "table", "", 7, 1, *box, 5.0)]
    got = structure.text_regions(spark.createDataFrame(rows, kind)).orderBy("region_page", "bottom").collect()
    assert [(r.block, r.region_page, r.bottom, r.length) for r in got] == [("a", 0, 10.0, 15), ("a", 0, 20.0, 30), ("a", 1, 30.0, 45)]


def test_line_runs(spark):
    boxes = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 12.0, 1.0, 20.0, 11.0), (1, 1, 100.0, 0.0, 110.0, 10.0), (1, 1, 0.0, 40.0, 5.0, 50.0), (1, 1, 3.0, 3.0, 3.0, 3.0), (1, 1, None, 0.0, 1.0, 1.0)]
    got = structure.line_runs(spark.createDataFrame(boxes, "doc int, page int, left double, top double, right double, bottom double")).collect()
    assert sorted((r.left, r.top, r.right, r.bottom) for r in got) == [(0.0, 0.0, 20.0, 11.0), (0.0, 40.0, 5.0, 50.0), (100.0, 0.0, 110.0, 10.0)]


def test_ranges_stay_out_of_formulas(spark):
    text = "abcd $x + y$ ef"
    got = value(spark, structure.proportional_ranges(F.lit(text), F.array(F.lit(1), F.lit(0), F.lit(1))))
    assert [text[r.start : r.end] for r in got] == ["abcd ", "$x + y$", " ef"]


def test_alignment():
    assert structure.aligned("fine", "a fine day") == ([2, 3, 4, 5], [])
    assert structure.aligned("ab c", "abc then abc")[0] == [0, 1, -1, 2], "the first place, blanks aside"
    assert structure.aligned("of ﬁne work", "xx of fine-work")[0] == [3, 4, -1, 7, 8, 9, -1, 11, 12, 13, 14] or structure.aligned("of ﬁne work", "xx of fine-work")[0][:2] == [3, 4]
    assert structure.aligned("abcdefghij", "abcdef")[0] == [0, 1, 2, 3, 4, 5, -1, -1, -1, -1], "seven tenths of the shorter text"
    assert structure.aligned("the sum $x+y$ is small", "the sum (x+y) is small") == ([0, 1, 2, -1, 4, 5, 6] + [-1] * 7 + [14, 15, -1, 17, 18, 19, 20, 21], [(8, 13, 8, 13)])
    assert structure.aligned("entirely", "zzzz") is None and structure.aligned("ab", "bcb", most_cells=3) is None and structure.aligned("", "a") is None and structure.aligned("- -", "a") is None


@pytest.mark.parametrize("seed", range(20))
def test_common_subsequences_are_longest(seed):
    rng = random.Random(seed)
    a, b = (np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 25))]) for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
    pairs = structure._common(a, b, 0.0)
    assert len(pairs) == best[-1][-1] and all(a[i] == b[k] for i, k in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_quote_boxes(spark):
    box = lambda i: (float(i % 5 * 10), float(i // 5 * 20), float(i % 5 * 10 + 8), float(i // 5 * 20 + 15)) if i != 2 else None
    text = "ab cd efab .E xy"
    kind = "struct<left: double, top: double, right: double, bottom: double>"
    pages = spark.createDataFrame([(1, text, [box(i) for i in range(len(text))])], f"page int, text string, glyphs array<{kind}>")
    quotes = spark.createDataFrame([(1, 1, "b c d", None), (2, 1, "ab", None), (3, 1, "ab", (0.0, 0.0, 20.0, 16.0)), (4, 1, "zz", None), (5, 1, " ", None), (6, 2, "b", None), (7, 1, "def", None), (8, 1, ".E", None), (9, 1, "xy", (0.0, 0.0, 1.0, 1.0))],
                                   f"id int, page int, quote string, within {kind}")
    got = {r.id: [tuple(b) for b in r.boxes] for r in structure.quote_boxes(pages, quotes).collect()}
    assert got == {1: [(10.0, 0.0, 48.0, 15.0)], 3: [(0.0, 0.0, 18.0, 15.0)], 7: [(40.0, 0.0, 48.0, 15.0), (10.0, 20.0, 28.0, 35.0)], 8: [(10.0, 40.0, 28.0, 55.0)]}


def test_bound_paragraphs(spark):
    views = spark.createDataFrame([("d", "One two. $x$ Same. Three\nSame. One two. Lost")], "doc string, text string")
    rows = [("d", 1, "a", "source", "One  two.", 0, 8), ("d", 2, "b", "source", "Same.", None, None), ("d", 3, "c", "source", "x Same.", None, None), ("d", 4, "e", "source", "Same.", None, None),
            ("d", 5, "f", "source", "One two.", None, None), ("d", 6, "g", "source", "Three", 0, 3), ("d", 7, "h", "source", "absent", None, None), ("d", 8, "i", "source", " $ ", None, None), ("d", 9, "j", "source", "Lost", None, None), ("d", 10, "k", "source", "Lost", None, None)]
    entries = spark.createDataFrame(rows, "doc string, n int, id string, language string, text string, start int, end int")
    got = {(r.id, r.start, r.end) for r in structure.bound_paragraphs(views, entries).collect()}
    # "OnetwoxSame..." without blanks and dollar signs; the marked first paragraph takes its place from the fifth.
    assert got == {("a", 0, 7), ("b", 8, 13), ("e", 18, 23), ("c", 7, 13), ("f", 23, 30), ("g", 13, 18)}


def test_headings_and_markers(spark):
    md = "# 2.1 Methods\n### Results ##\n# Other\ntext"
    assert value(spark, structure.heading_levels(F.lit(md), F.array(F.lit("Methods"), F.lit("Results")))) == "## 2.1 Methods\n## Results\n# Other\ntext"
    paragraph = lambda a, b, t, i: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text"), F.lit(i).cast("string").alias("id"))
    marked = value(spark, structure.marked_paragraphs(F.lit("one two three"), F.array(paragraph(0, 3, "one", "??>"), paragraph(2, 7, "e two", "x"), paragraph(4, 7, "TWO", "y"), paragraph(8, 13, "three", None))))
    assert marked == "\n\n<!-- reader-pair:Pz8- -->\n\none\n\n<!-- reader-end -->\n\n two three"


def test_snapshot_problems(spark):
    docs, marks = spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([("1",), ("2",), (None,)], "docId string")
    foreign = {("marks", "docId"): ("docs", "id")}
    tables = {"docs": docs, "marks": marks}
    assert library.snapshot_problems(tables, {"docs": ("id",), "marks": ("docId",)}, 3, 5, foreign) == ["orphans in marks.docId"]
    assert library.snapshot_problems(tables, {"docs": ("id", "title"), "gone": ("x",)}, 9, 5, foreign) == ["unsupported version", "no column docs.title", "no table gone"]
    assert library.snapshot_problems(tables, {"docs": ("id",)}, 0, 5, {}) == ["invalid version"] and not library.snapshot_problems(tables, {}, 1, 5, foreign, allow_orphans=True)
