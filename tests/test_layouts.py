"""Nested layouts and PDF bytes against plain Python."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.sources import layouts

NAMES = ("content", "item_content", "list_content", "list_items", "children")


def text_of(node):
    if isinstance(node, str):
        return [node] if node else []
    if isinstance(node, list):
        return [t for part in node for t in text_of(part)]
    if isinstance(node, dict):
        return text_of(next((node[n] for n in NAMES if node.get(n) is not None), None))
    return []


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["a", "bé", "", "x y", 5, None, True, 1.5])
    if kind < 0.65:
        return [tree(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {n: tree(rng, depth - 1) for n in rng.sample([*NAMES, "other"], rng.randint(0, 3))}


def test_joined_text_of_random_trees(spark):
    rng = random.Random(1)
    trees = [tree(rng, rng.randint(0, 7)) for _ in range(200)] + ["deep"]
    for _ in range(12):
        trees[-1] = {"children": [trees[-1]]}
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id int, j string").select("id", F.parse_json("j").alias("node"))
    got = {r.id: r.text for r in layouts.joined_text(rows, ["id"]).collect()}
    assert got == {i: " ".join(text_of(t)) for i, t in enumerate(trees) if text_of(t)}


def test_nested_blocks(spark):
    pages = [[{"type": "title", "content": {"level": 1, "title_content": "T"}}, {"type": "title", "content": {"level": 2, "title_content": ["S", {"content": "ub"}]}},
              {"type": "table", "bbox": [100, 100, 50, 200], "content": {"html": "<table/>", "table_caption": "Table 1", "table_footnote": ["note"]}},
              {"type": "code", "content": {"code_content": "x", "code_caption": ["L", ""], "wrong_caption": " "}}],
             [{"type": "title", "content": {"level": 1, "title_content": "U"}}, {"type": "list", "bbox": [0, 0, 500, 250], "content": {"list_items": [{"item_content": "i"}, "k"]}}], []]
    bodies = [("a", json.dumps(pages)), ("bad", json.dumps([[{"type": "p", "content": {}}], "no page"])), ("untyped", json.dumps([[{"content": {}}]])), ("text", json.dumps([[{"type": "p", "content": "t"}]])), ("none", None), ("broken", "{"), ("object", "{}")]
    sizes = spark.createDataFrame([("a", 1, 1000.0, 2000.0)], "doc string, page int, width double, height double")
    out = layouts.nested_blocks(spark.createDataFrame(bodies, "doc string, body string"), "doc", "body", sizes)
    got = sorted((r.page, r.n, r.part, r.block, r.label, r.content, r.parent, r.caption_kind, r.right) for r in out.collect())
    assert got == [
        (0, 0, 0, "mu_p0_v0", "doc_title", "T", None, None, None), (0, 1, 0, "mu_p0_v1", "paragraph_title", "S ub", None, None, None),
        (0, 2, 0, "mu_p0_v2", "table", "<table/>", "mu_p0_v2", None, None), (0, 2, 1, "mu_p0_v2_note", "vision_footnote", "note", "mu_p0_v2", None, None),
        (0, 2, 2, "mu_p0_v2_cap", "figure_title", "Table 1", "mu_p0_v2", "table", None), (0, 3, 0, "mu_p0_v3", "code", "x", None, None, None),
        (0, 3, 2, "mu_p0_v3_code_caption", "code_caption", "L", "mu_p0_v3", None, None), (1, 0, 0, "mu_p1_v0", "paragraph_title", "U", None, None, None),
        (1, 1, 0, "mu_p1_v1", "text", "i k", None, None, 1000.0)]


@given(st.text(max_size=40), st.sampled_from(["literal", "octal", "hex", "utf16", "utf16le", "brackets"]))
def test_every_way_to_write_a_string(text, way):
    raw = text.encode("utf-8", "surrogatepass")
    escaped = b"".join(b"\\" + bytes([b]) if b in b"()\\" else {10: b"\\n", 13: b"\\r", 9: b"\\t", 8: b"\\b", 12: b"\\f"}.get(b, bytes([b])) for b in raw)
    written = {"literal": b"(" + escaped + b")", "octal": b"(" + b"".join(b"\\%03o" % b for b in raw) + b")", "hex": b"<" + raw.hex().encode() + b">",
               "utf16": b"<feff" + text.encode("utf-16-be", "surrogatepass").hex().encode() + b">", "utf16le": b"<FFFE " + text.encode("utf-16-le", "surrogatepass").hex().encode() + b">",
               "brackets": b"((" + escaped + b"\\\n))"}[way]
    got = layouts.info_field(b"%PDF /Titles (no) /Title 7 0 R << /Title <</A 1>> /Title\n " + written + b" /Author (x)", "Title")
    if way in ("utf16", "utf16le"):
        want = text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")
    else:
        want = layouts._decoded(raw)
    want = f"({want})" if way == "brackets" else want
    assert (got or "") == " ".join(want.split()) or raw[:2] in (b"\xfe\xff", b"\xff\xfe")


def test_pdf_info(spark):
    rows = [(1, b"/Title (C:\\\\temp\\\\a.dvi) /Author (A and B; CNKI) /Subject (J. 2019 doi:10.1000/xyz)"), (2, b"/Title (A study, open"), (3, b"\xff\x00"), (4, None), (5, b"/Title (Grand) /Author (Sandy Land)")]
    got = {r.id: (r.title, r.authors, r.year, r.doi) for r in layouts.pdf_info(spark.createDataFrame(rows, "id int, c binary"), "id", "c").collect()}
    assert got == {1: (None, ["A", "B"], "2019", "10.1000/xyz"), 2: ("A study, open", [], None, None), 3: (None, [], None, None), 4: (None, [], None, None), 5: ("Grand", ["Sandy Land"], None, None)}
