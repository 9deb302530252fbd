"""Places in long texts, in time that grows with the text: matches, pieces, running states, overlaps, cuts.

A function that runs once an element must hold no expression over the whole text, which would be evaluated for each element, and
an array that grows element by element is copied as often. So values are bound once (`let`), gaps and matches are zipped, and
running states are found in rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a piece that texts are cut from.
CUT = 1024
#: Characters from which a pattern is long: longer than any here but that of captions.
LONG = 2000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used, inside functions too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The states after each element, from those that the elements are by themselves; add must be associative.

    In rounds: after each, a state reaches twice as far back. So every round makes one new array, and there are as many rounds as the
    logarithm of the length."""
    def rounds(v: Column) -> Column:
        reaches = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda n: n < F.size(v))
        return F.aggregate(reaches, v, lambda now, n: F.transform(now, lambda x, i: F.when(i >= n, add(F.get(now, i - n), x)).otherwise(x)))

    return let(values, rounds)


def sums(numbers: Column) -> Column:
    """The sum of the elements before each: array of int."""
    def exclusive(v: Column) -> Column:
        return F.zip_with(running(v, lambda a, b: a + b), v, lambda upto, x: upto - x)

    return let(numbers, exclusive)


def placed(text: Column, pattern: str | Column, around: bool = False) -> Column:
    """All matches in order: array of (start, end, value), and the text before and after up to the next matches if asked for.
    The pattern, which may be a row's own, must not match the empty text."""
    long = isinstance(pattern, str) and len(pattern) > LONG
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    if long:  # A split compiles its pattern anew for every row, so a long one is extended by what stands before a match or the end.
        between = F.regexp_extract_all(text, F.concat(F.lit("(?s:(.*?))(?:"), pattern, F.lit(r"|\z)")), F.lit(1))

    def zipped(gaps: Column) -> Column:
        pairs = F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("value"), g.alias("before")))
        if around:
            pairs = F.zip_with(pairs, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))),
                               lambda p, g: F.struct(p["value"].alias("value"), p["before"].alias("before"), g.alias("after")))
        return F.filter(pairs, lambda p: p["value"].isNotNull())

    def one(p: Column, upto: Column) -> Column:
        start = upto + F.length(p["before"])
        more = [p[n].alias(n) for n in ("before", "after")] if around else []
        return F.struct(start.alias("start"), (start + F.length(p["value"])).alias("end"), p["value"].alias("value"), *more)

    def all_placed(pairs: Column) -> Column:
        return F.zip_with(pairs, sums(F.transform(pairs, lambda p: F.length(p["before"]) + F.length(p["value"]))), one)

    return let(let(between, zipped), all_placed)


def pieces(text: Column, separator: str) -> Column:
    """What stands between separators: array of (start, end, value), empty ones too."""
    parts, between = F.split(text, separator, -1), F.regexp_extract_all(text, F.lit(separator), F.lit(0))
    pairs = F.zip_with(parts, between, lambda v, g: F.struct(v.alias("value"), F.coalesce(F.length(g), F.lit(0)).alias("gap")))

    def one(p: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(p["value"])).alias("end"), p["value"].alias("value"))

    return let(pairs, lambda v: F.zip_with(v, sums(F.transform(v, lambda p: F.length(p["value"]) + p["gap"])), one))


def cutting(text: Column, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """use(cut), where cut(start, end) is that stretch of the text and costs as much as the stretch, not as the text before it."""
    def bound(parts: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / CUT).cast("int")
            count = F.greatest(F.floor(end / CUT).cast("int") - first + 1, F.lit(0))
            return F.substr(F.array_join(F.slice(parts, first + 1, count), ""), start - first * CUT + 1, F.greatest(end - start, F.lit(0)))

        return use(cut)

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0)), bound)


def replaced(text: Column, ranges: Column, new: Callable[[Column], Column]) -> Column:
    """The text with new(range) in place of every range (start, end, ...), which are in order of start. One that starts inside what has
    been replaced before it leaves nothing of its own, but what it reaches goes as well."""
    ends = running(F.transform(ranges, lambda r: r["end"]), lambda a, b: F.greatest(a, b))

    def joined(upto: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), upto)

        def out(cut: Callable[[Column, Column], Column]) -> Column:
            def one(r: Column, at: Column) -> Column:
                return F.when(r["start"] >= at, F.concat(cut(at, r["start"]), new(r))).otherwise(F.lit(""))

            pairs = F.filter(F.zip_with(ranges, before, lambda r, at: F.struct(r.alias("r"), at.alias("at"))), lambda p: p["r"].isNotNull())
            return F.concat(F.array_join(F.transform(pairs, lambda p: one(p["r"], p["at"])), ""), cut(F.element_at(before, -1), F.length(text)))

        return cutting(text, out)

    return let(ends, joined)


def overlaps(items: Column, layers: list[Column]) -> Column:
    """For each item (start, end; in order, apart, not empty) the first range it overlaps: array of (start, layer), null where there is
    none. Each layer is an array of (start, end) in order, whose ranges do not overlap each other; of ranges that start at one place the
    lower layer's is first. One sort and two running states, not a look at every pair."""
    def told(array: Column, layer: int, late: int) -> Column:
        return F.transform(array, lambda r: F.struct(r["start"].alias("at"), F.lit(late).alias("late"), F.lit(layer).alias("layer"), r["end"].alias("end")))

    ways = range(len(layers))
    events = F.array_sort(F.concat(*(told(a, n, 0) for n, a in enumerate(layers)), told(items, -1, 1)))

    def begun(e: Column) -> Column:
        return F.struct(*(F.when(e["layer"] == n, F.struct(e["end"].alias("end"), e["at"].alias("start"))).alias(f"l{n}") for n in ways))

    def latest(a: Column, b: Column) -> Column:
        return F.struct(*(F.greatest(a[f"l{n}"], b[f"l{n}"]).alias(f"l{n}") for n in ways))

    def found(e: Column) -> Column:
        return F.when(e["layer"] >= 0, F.struct(e["at"].alias("start"), e["layer"].alias("layer")))

    def joined(all_events: Column) -> Column:
        before = running(F.transform(all_events, begun), latest)
        after = F.reverse(running(F.transform(F.reverse(all_events), found), lambda a, b: F.coalesce(b, a)))
        pairs = F.zip_with(all_events, before, lambda e, s: F.struct(e.alias("e"), s.alias("before")))
        triples = F.zip_with(pairs, after, lambda p, s: F.struct(p["e"].alias("e"), p["before"].alias("before"), s.alias("after")))

        def first(t: Column) -> Column:
            reach = [F.when(t["before"][f"l{n}"]["end"] > t["e"]["at"], F.struct(t["before"][f"l{n}"]["start"].alias("start"), F.lit(n).alias("layer"))) for n in ways]
            return F.array_min(F.array(*reach, F.when(t["after"]["start"] < t["e"]["end"], t["after"])))

        return F.transform(F.filter(triples, lambda t: t["e"]["late"] == 1), first)

    return let(events, joined)

