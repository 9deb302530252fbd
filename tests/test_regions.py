"""Regions of figures against a plain scan of random pages."""

import random

from paperloom.operators import regions

BLOCK = "doc string, page int, block int, label string, content string, parent string, left double, top double, right double, bottom double"
STOPS = {"text", "header", "footer"}


def grown(page, caption, visuals, notes):
    """The region by looking in each direction edge by edge; boxes are lists left, top, right, bottom."""
    left, right = min(b[6] for b in page), max(b[8] for b in page)
    c = caption[6:]
    areas = dict.fromkeys(("above", "below", "left", "right"), 0)
    for v in (b[6:] for b in page if b[3] == "image"):
        area = (v[2] - v[0]) * (v[3] - v[1])
        if v[2] > left and v[0] < right:
            areas["above"] += area if v[3] <= c[1] else 0
            areas["below"] += area if v[1] >= c[3] else 0
        if v[3] > c[1] and v[1] < c[3]:
            areas["left"] += area if v[2] <= c[0] else 0
            areas["right"] += area if v[0] >= c[2] else 0
    way = max(areas, key=areas.get)
    side = {"above": lambda b: b[3] <= c[1], "below": lambda b: b[1] >= c[3], "left": lambda b: b[2] <= c[0], "right": lambda b: b[0] >= c[2]}[way]
    boxes = [v[6:] for v in visuals] + [n[6:] for n in notes if side(n[6:])]
    base = [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]
    mine = {caption[2], *(b[2] for b in visuals + notes)}
    stops = [b[6:] for b in page if b[2] not in mine and (b[3] in STOPS or b[3] == "figure_title")]
    if way in ("above", "below"):
        stops = [s for s in stops if s[2] > base[0] and s[0] < base[2]]
        size = base[3] - base[1]
    else:
        stops = [s for s in stops if s[3] > base[1] and s[1] < base[3]]
        size = base[2] - base[0]
    end = {"above": max([0, *(s[3] for s in stops if s[3] < base[1])]), "left": max([0, *(s[2] for s in stops if s[2] < base[0])]),
           "below": min([max(b[9] for b in page), *(s[1] for s in stops if s[1] > base[3])]), "right": min([right, *(s[0] for s in stops if s[0] > base[2])])}[way]
    edge = {"above": 1, "below": 3, "left": 0, "right": 2}[way]
    faces = {"above": c[1] >= base[3], "below": c[3] <= base[1], "left": c[0] >= base[2], "right": c[2] <= base[0]}[way]
    gap = abs(end - base[edge])
    took = faces and gap >= 80 and gap / size >= 0.3
    if took:
        base[edge] = end + 8 if edge < 2 else end - 8
    if c[0] < base[2] and base[0] < c[2] and c[1] < base[3] and base[1] < c[3]:
        w, h = base[2] - base[0], base[3] - base[1]
        lost = {1: w * (c[3] - base[1]), 3: w * (base[3] - c[1]), 0: h * (c[2] - base[0]), 2: h * (base[2] - c[0])}
        at = min(lost, key=lost.get)
        new = {1: c[3] + 8, 3: c[1] - 8, 0: c[2] + 8, 2: c[0] - 8}[at]
        if new < base[at + 2] if at < 2 else new > base[at - 2]:
            base[at] = new
    return (way, *base), took


def test_random_pages(spark):
    rng = random.Random(11)
    rows, segments, want, ways, taken = [], [], {}, set(), 0
    for number in range(300):
        page = []
        for block in range(rng.randint(3, 7)):
            left, top = rng.randint(0, 700), rng.randint(0, 900)
            label = "figure_title" if block == 0 else "image" if block == 1 else rng.choice(["image", "text", "vision_footnote", "header"])
            page.append(("d", number, block, label, "Figure 1. Words" if block == 0 else "some words", None, float(left), float(top), float(left + rng.randint(20, 250)), float(top + rng.randint(20, 200))))
        visuals, notes = [b for b in page if b[3] == "image"][:2], [b for b in page if b[3] == "vision_footnote"]
        rows += page
        segments += [("d", number, 1, b[2]) for b in [page[0], *visuals, *notes]]
        want[number], took = grown(page, page[0], visuals, notes)
        ways, taken = ways | {want[number][0]}, taken + took
    got = {r.page: tuple(r)[3:] for r in regions.figure_regions(spark.createDataFrame(segments, "doc string, page int, figure int, block int"), spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == want and ways == set(regions.WAYS) and taken > 30


def test_without_captions_or_visuals(spark):
    rows = [("d", 1, 1, "image", None, None, 10.0, 10.0, 50.0, 50.0), ("d", 1, 2, "text", "(a)", None, 60.0, 10.0, 70.0, 20.0), ("d", 1, 3, "vision_footnote", "note", None, 0.0, 90.0, 50.0, 99.0), ("d", 1, 4, "figure_title", "Figure 1. A", None, 0.0, 0.0, 9.0, 9.0)]
    segments = [("d", 1, "bare", n) for n in (1, 1, 2, 3, 77)] + [("d", 1, "notes", n) for n in (3, 4)]
    blocks = spark.createDataFrame(rows, BLOCK)
    parts = spark.createDataFrame(segments, "doc string, page int, figure string, block int")
    got = {r.figure: tuple(r)[3:] for r in regions.figure_regions(parts, blocks).collect()}
    assert got == {"bare": (None, 10.0, 10.0, 70.0, 50.0), "notes": (None, 0.0, 17.0, 50.0, 99.0)}
    assert regions.figure_regions(parts.limit(0), blocks).count() == 0
