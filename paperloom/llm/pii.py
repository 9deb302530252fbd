"""Personal data: validated patterns, and bootstrapped contextual extraction. DataFrame functions only.

Base spans are found by pattern and kept if they pass their check (digits, ranges, Luhn). They are the seeds: mentions of
digits or addresses that overlap one are its occurrences, and the words around an occurrence, with the shape of the mention,
are lexical patterns: the word before, the two words before, and the word after, as far away as they may stand. Over the graph
of patterns and mentioned values Spark scores in rounds: a pattern by the share of its values that are known for a kind, a value
by the patterns it stands in. Values that confident patterns agree on are unseen identifiers; they count as known in the next
round, until a round finds no more. Their mentions are added as spans; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.places import let, overlaps, placed, replaced
from paperloom.llm.tables import stored

#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
# The patterns, written so that Java's engine neither recurses nor starts again inside a run it has already refused: groups
# are possessive where nothing after them could take characters back, and a match starts only where a run starts (or where
# the match before has ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried at all.
_MAY = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: A mention: digits with up to two separators between, or something with an at sign.
MENTION = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[().\x20-]{0,2}[0-9])++(?![A-Za-z])|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++"
#: Fewest digits of a mention that is neither an address nor four numbers with dots between.
MIN_DIGITS = 7
MIN_SEEDS, MIN_PATTERN, MIN_VALUE = 3, 0.6, 0.9
#: The most documents with added spans that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 50_000
_SPAN = "array<struct<start: int, rank: int, end: int>>"


def _words_around(before: Column, after: Column) -> dict[str, Column]:
    """The last and the last but one word before a place and the first behind it, in lower case; empty if there is none. The text
    before is read backwards, so that the pattern is anchored and a long one costs no search."""
    back = F.reverse(before)
    last = r"^[^\p{L}]*+(\p{L}++)"
    word = lambda text, pattern: F.lower(F.regexp_extract(text, pattern, 1))
    return {"left": F.reverse(word(back, last)), "left2": F.reverse(word(back, r"^[^\p{L}]*+\p{L}++[^\p{L}]++(\p{L}++)")), "right": word(after, last)}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    digits = F.split(F.reverse(_digits(value)), "(?!$)")
    return F.aggregate(F.transform(digits, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(_BYTE))
    if kind == "card":
        return F.when(count.between(12, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _kind_spans(text: Column, rank: int, kind: str) -> Column:
    """The validated spans of one kind, in order."""
    may = text.contains("@") if kind == "email" else text.rlike(_MAY[kind])
    valid = F.filter(placed(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    spans = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    return F.when(may, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """The validated spans of a text that is not null, by start, then kind: array of (start, rank of the kind, end)."""
    return F.array_sort(F.concat(*(_kind_spans(text, rank, kind) for rank, kind in enumerate(KINDS))))


def _mentions(text: Column) -> Column:
    """Mentions in order: array of (start, end, value, left, left2, right)."""
    told = lambda v: v.contains("@") | (F.length(_digits(v)) >= MIN_DIGITS) | v.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")

    def with_words(m: Column) -> Column:
        words = _words_around(m["before"], m["after"])
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), *(c.alias(n) for n, c in words.items()))

    kept = F.transform(F.filter(placed(text, MENTION, around=True), lambda m: told(m["value"])), with_words)
    empty = F.array().cast("array<struct<start: int, end: int, value: string, left: string, left2: string, right: string>>")
    return F.when(text.rlike(r"@|[0-9]\.[0-9]++\.[0-9]|[0-9](?:[().\x20-]{0,2}[0-9]){6}"), kept).otherwise(empty)


def _seeded(mentions: Column, base: Column) -> Column:
    """Each mention with the kind of the first base span that it overlaps (rank; null: none): array of (m, rank)."""
    def of_rank(k: int) -> Column:
        return F.filter(base, lambda b: b["rank"] == k)

    layers = [of_rank(k) for k in range(len(KINDS))]
    return F.zip_with(mentions, overlaps(mentions, layers), lambda m, o: F.struct(m.alias("m"), o["layer"].alias("rank")))


def _key(doc_id: Column, text: Column) -> list[Column]:
    """What identifies a row's text: rows that repeat id and text have equal spans."""
    return [doc_id.cast("string").alias("key_id"), F.md5(text.cast("binary")).alias("key_text")]


def _occurrences(scanned: DataFrame) -> DataFrame:
    """One row a mention: its row's key, place, value, the seed kind it overlaps (null: none), and its patterns."""
    some = scanned.filter(F.size("mentions") > 0)
    seeded = F.when(F.size("base") > 0, _seeded(F.col("mentions"), F.col("base"))).otherwise(F.transform("mentions", lambda m: F.struct(m.alias("m"), F.lit(None).cast("int").alias("rank"))))
    one = some.select("key_id", "key_text", F.explode(seeded).alias("s")).select("key_id", "key_text", "s.m", "s.rank")
    shape = F.regexp_replace(F.regexp_replace("m.value", "[0-9]+", "9"), r"\p{L}+", "a")
    left, left2, right = (F.col(f"m.{n}") for n in ("left", "left2", "right"))
    patterns = F.array(F.when(left != "", F.concat_ws(" ", F.lit("<"), left, shape)), F.when(left2 != "", F.concat_ws(" ", F.lit("<<"), left2, left, shape)),
                       F.when(right != "", F.concat_ws(" ", F.lit(">"), right, shape)))
    patterns = F.filter(patterns, lambda p: p.isNotNull())
    return one.select("key_id", "key_text", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("value"), "rank", patterns.alias("patterns"))


def discovered(occurrences: DataFrame) -> DataFrame:
    """(value, rank): values that are no seeds, and the kind that their patterns give them.

    A round scores patterns by what is known and adds the values that they are sure of; what has been added stays, so the rounds
    end, at the latest when every value of the graph is known."""
    seeds = stored(occurrences.filter("rank IS NOT NULL").select("value", "rank").distinct().withColumn("score", F.lit(1.0)), "seeds")
    edges = stored(occurrences.select("value", F.explode("patterns").alias("pattern")).distinct(), "graph")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("values"))
    added, known = None, seeds
    while True:
        scored = edges.join(known, "value").groupBy("pattern", "rank").agg(F.sum("score").alias("known"), F.count("*").alias("members"))
        patterns = scored.filter(F.col("members") >= MIN_SEEDS).join(totals, "pattern").select("pattern", "rank", (F.col("known") / (F.col("values") + 1)).alias("trust")).filter(F.col("trust") >= MIN_PATTERN)
        found = edges.join(patterns, "pattern").join(known.select("value"), "value", "left_anti")
        # A value's score is that one of its trusted patterns is right; the product of the doubts, by logarithms.
        values = found.groupBy("value", "rank").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))).alias("score"))
        values = values.groupBy("value").agg(F.max_by(F.struct("rank", "score"), F.struct("score", -F.col("rank"))).alias("best")).select("value", "best.rank", "best.score")
        values = stored(values.filter(F.col("score") >= MIN_VALUE), "values")
        new = not values.isEmpty()
        added = values if added is None else added.unionByName(values) if new else added
        if not new:
            return added.select("value", "rank")
        known = seeds.unionByName(added)


def added_spans(rows: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (key, id, base, and the carried columns) of rows (id, t, ...), and the added spans by key (more: array of
    (start, rank, end))."""
    scanned = rows.select("id", *carried, *_key(F.col("id"), F.col("t")), base_spans(F.col("t")).alias("base"), _mentions(F.col("t")).alias("mentions"))
    scanned = stored(scanned, "scanned")
    occurrences = stored(_occurrences(scanned), "occurrences")
    fresh = occurrences.filter("rank IS NULL").drop("rank", "patterns").join(discovered(occurrences), "value")
    more = fresh.groupBy("key_id", "key_text").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "end"))).alias("more"))
    return scanned.drop("mentions"), stored(more, "added")


def _with_added(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with column spans: base and added spans in order."""
    more = more.select(F.col("key_id").alias("more_id"), F.col("key_text").alias("more_text"), "more")
    same = F.col("key_id").eqNullSafe(F.col("more_id")) & (F.col("key_text") == F.col("more_text"))
    small = more.count() <= MAX_BROADCAST
    joined = rows.join(F.broadcast(more) if small else more, same, "left").drop("more_id", "more_text")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))).drop("more")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans, both arrays of (start, rank of the kind in KINDS, end) in code points, end exclusive.

    A null or empty text has no spans; very long ones are read whole. Rows that repeat id and text have the same spans.
    Overlapping spans of different kinds are all listed. Other columns are ignored, whatever their names; an empty table gives no
    rows.
    """
    scanned, more = added_spans(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    return _with_added(scanned, more).select(F.col("id").alias(doc_id), "base", "spans")


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def counted(spans: str, rank: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans are replaced as one, by the
    kind that starts first. Null texts stay null, very long ones are read whole, all columns stay, whatever their names. Rows that
    repeat stay rows; an empty table gives no rows."""
    columns = docs.columns
    content = F.coalesce(F.col(f"original.`{text}`"), F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("original"))
    rows, more = added_spans(whole.select("original", F.col(f"original.`{doc_id}`").alias("id"), content.alias("t")), ("original",))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    cleaned = let(F.col("spans"), lambda spans: replaced(content, spans, lambda s: F.get(names, s["rank"])))
    new = F.when(F.size("spans") > 0, cleaned).otherwise(F.col(f"original.`{text}`"))
    return _with_added(rows, more).select(*((new.alias(c) if c == text else F.col(f"original.`{c}`").alias(c)) for c in columns))
