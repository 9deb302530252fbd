"""Record linkage: duplicate rule, blocked pairs, order-sensitive imports, backup id maps, three-way merges, fuzzy titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators.components import components
from paperloom.operators.grouped import fold_groups
from paperloom.sources.scratch import stored

#: Columns of a bibliographic record beside its id.
FIELDS = ("title", "authors", "journal", "year", "doi", "keywords")
#: The most records that one task folds in order.
MAX_GROUP = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the keys that the duplicate rule compares: doi_key, title_key, year_key, author_key (blank: null)."""
    def key(c: Column) -> Column:
        return F.nullif(T.comparison_key(c), F.lit(""))

    return docs.withColumns({
        "doi_key": F.lower(T.trim_to_null(F.col("doi"))), "title_key": key(F.col("title")), "year_key": key(F.col("year")),
        "author_key": key(F.get("authors", F.lit(0)))})


def duplicate_rule(a: str, b: str) -> Column:
    """Two DOIs decide alone; without both, an equal title with an equal year or first author does."""
    both = F.col(f"{a}.doi_key").isNotNull() & F.col(f"{b}.doi_key").isNotNull()
    more = (F.col(f"{a}.year_key") == F.col(f"{b}.year_key")) | (F.col(f"{a}.author_key") == F.col(f"{b}.author_key"))
    return F.when(both, F.col(f"{a}.doi_key") == F.col(f"{b}.doi_key")).otherwise((F.col(f"{a}.title_key") == F.col(f"{b}.title_key")) & F.coalesce(more, F.lit(False)))


def duplicates(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Candidates (incoming id) with the existing record they duplicate: by DOI before by title, then the smallest id.

    Two equi-joins, not one on either key, so each is hashed and none is a nested loop.
    """
    e = keyed(existing).select("id", "doi_key", "title_key", "year_key", "author_key").alias("e")
    i = keyed(incoming).select("id", "doi_key", "title_key", "year_key", "author_key").alias("i")
    parts = []
    for order, key in enumerate(("doi_key", "title_key")):
        pair = i.join(e, F.col(f"i.{key}") == F.col(f"e.{key}")).filter(duplicate_rule("e", "i"))
        parts.append(pair.select(F.col("i.id").alias("id"), F.lit(order).alias("by"), F.col("e.id").alias("duplicate_of")))
    return parts[0].unionByName(parts[1]).groupBy("id").agg(F.min(F.struct("by", "duplicate_of")).alias("m")).select("id", "m.duplicate_of")


def _fold(rows: list[dict]) -> list[tuple]:
    """Accept rows, which are in order, unless one accepted before is a duplicate: (ordinal, id, accepted, target)."""
    dois: dict = {}
    titles: dict = {}
    out = []
    for r in rows:
        doi, title = r["doi_key"], r["title_key"]
        hit = dois.get(doi) if doi is not None else None
        for o in titles.get(title, ()) if hit is None and title is not None else ():
            both = doi is not None and o["doi_key"] is not None
            if not both and any(r[k] is not None and r[k] == o[k] for k in ("year_key", "author_key")):
                hit = o["id"]
                break
        if hit is None:
            if doi is not None:
                dois.setdefault(doi, r["id"])
            if title is not None:
                titles.setdefault(title, []).append(r)
        out.append((r["ordinal"], r["id"], hit is None, hit if hit is not None else r["id"]))
    return out


_KEYS = ("doi_key", "title_key", "year_key", "author_key")
_LINKS = (("doi_key",), ("title_key", "year_key"), ("title_key", "author_key"))


def _first_matches(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows with by_doi and by_title: struct(ordinal, id) of the first of others that the duplicate rule matches by DOI, and by title.

    Minima by key, combined before the shuffle, so a key that very many records share is no product of pairs."""
    one = F.min(F.struct("ordinal", "id"))
    out = rows
    for n, link in enumerate(_LINKS):
        bare = F.when(F.col("doi_key").isNull(), F.struct("ordinal", "id"))
        found = others.dropna(subset=list(link)).groupBy(*link).agg(one.alias(f"_any{n}"), F.min(bare).alias(f"_bare{n}"))
        out = out.join(found, list(link), "left")
    # Two DOIs decide alone, so a record with one matches by title only those without.
    titles = [F.when(F.col("doi_key").isNull(), F.col(f"_any{n}")).otherwise(F.col(f"_bare{n}")) for n in (1, 2)]
    return out.select("ordinal", "id", *_KEYS, F.col("_any0").alias("by_doi"), F.least(*titles).alias("by_title"))


def _folded(rows: DataFrame, most: int) -> DataFrame:
    """The ordinals of the records that are accepted. Components of more than `most` records are first thinned out in rounds: those
    that no undecided earlier record matches are accepted, those that an accepted one matches are out."""
    left, accepted = rows, []
    while True:
        edges = []
        for link in _LINKS:
            least = left.dropna(subset=list(link)).groupBy(*link).agg(F.min("ordinal").alias("least"))
            edges.append(left.join(least, list(link)).select(F.col("ordinal").alias("u"), F.col("least").alias("v")))
        root = components(reduce(DataFrame.union, edges))
        left = stored(left.join(root, F.col("ordinal") == F.col("node"), "left").select("ordinal", "id", *_KEYS, F.coalesce("root", "ordinal").alias("label")), "labelled")
        large = left.groupBy("label").count().filter(F.col("count") > most).select("label")
        if large.isEmpty():
            folded = fold_groups(left, ["label"], ["ordinal"], _fold, "ordinal long, id string, accepted boolean, target string")
            return reduce(DataFrame.union, accepted, folded.filter("accepted").select("ordinal"))
        early = lambda c: F.coalesce(F.col(f"{c}.ordinal") < F.col("ordinal"), F.lit(False))
        free = stored(_first_matches(left, left).filter(~early("by_doi") & ~early("by_title")).select("ordinal", "id", *_KEYS), "accepted")
        rest = _first_matches(left.join(free.select("ordinal"), "ordinal", "left_anti"), free).filter("by_doi IS NULL AND by_title IS NULL")
        accepted.append(free.select("ordinal"))
        left = stored(rest.select("ordinal", "id", *_KEYS), "undecided")


def fold_import(incoming: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """Batch import where each accepted record joins the index before the next one is judged (column ordinal gives the order; no two
    records have the same). Returns id, accepted, target (the record an id ends up as) per row.

    Records whose keys are all equal duplicate each other, so only the first of them takes part. Those left that share a DOI,
    or a title with a year or first author, form components, which are folded in order each by itself, by at most `most` records a
    task. Rows may repeat an id; a null in a key matches nothing; an empty table gives no rows.
    """
    k = keyed(incoming).select("id", F.col("ordinal").cast("long").alias("ordinal"), *_KEYS)
    alike = F.col("doi_key").isNotNull() | (F.col("title_key").isNotNull() & F.coalesce("year_key", "author_key").isNotNull())
    own = F.sha2(F.to_json(F.struct(*(F.col(c) for c in _KEYS), F.when(~alike, F.col("ordinal")).alias("alone"))), 256)
    k = stored(k.withColumn("record", own), "incoming")
    first = stored(k.groupBy("record").agg(F.min(F.struct("ordinal", "id", *_KEYS)).alias("f")).select("record", "f.*"), "first")
    accepted = stored(first.join(_folded(first.drop("record"), most), "ordinal", "left_semi").drop("record"), "accepted")
    # Others than accepted records match the first accepted one before them, by DOI before by title. (One of their DOI that comes later
    # may have been accepted, of their title the first is always earlier.)
    by_doi = F.when(F.col("by_doi.ordinal") < F.col("ordinal"), F.col("by_doi.id"))
    matched = _first_matches(first.drop("record"), accepted).select("ordinal", F.coalesce(by_doi, F.col("by_title.id")).alias("match"))
    is_in = accepted.select("ordinal", F.lit(True).alias("in"))
    verdict = first.select("record", "ordinal", F.col("id").alias("first_id")).join(is_in, "ordinal", "left").join(matched, "ordinal")
    verdict = verdict.select("record", F.col("ordinal").alias("first_ordinal"), F.coalesce("in", F.lit(False)).alias("in"), F.when(F.col("in"), F.col("first_id")).otherwise(F.col("match")).alias("target"))
    return k.join(verdict, "record").select("id", ((F.col("ordinal") == F.col("first_ordinal")) & F.col("in")).alias("accepted"), "target")


def backup_id_map(live: DataFrame, backup: DataFrame) -> DataFrame:
    """(old, new, how) for every backup record: its own id if it is live; a live record of its DOI; one of its title with its
    year or first author, DOIs not compared; else itself, added. Of several, the smallest id."""
    e, b = keyed(live).alias("e"), keyed(backup).alias("b")
    same = b.join(e, F.col("b.id") == F.col("e.id")).select(F.col("b.id").alias("old"), F.lit(0).alias("how"), F.col("e.id").alias("new"))
    doi = b.join(e, F.col("b.doi_key") == F.col("e.doi_key")).select(F.col("b.id").alias("old"), F.lit(1).alias("how"), F.col("e.id").alias("new"))
    more = (F.col("b.year_key") == F.col("e.year_key")) | (F.col("b.author_key") == F.col("e.author_key"))
    title = b.join(e, F.col("b.title_key") == F.col("e.title_key")).filter(more).select(F.col("b.id").alias("old"), F.lit(2).alias("how"), F.col("e.id").alias("new"))
    own = b.select(F.col("b.id").alias("old"), F.lit(3).alias("how"), F.col("b.id").alias("new"))
    every = reduce(DataFrame.unionByName, (same, doi, title, own))
    names = F.array(*(F.lit(n) for n in ("same", "doi", "title", "added")))
    return every.groupBy("old").agg(F.min(F.struct("how", "new")).alias("m")).select("old", "m.new", F.get(names, F.col("m.how")).alias("how"))


def _blank(c: str, kind: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0 if kind.startswith("array") else T.is_blank(F.col(c)) if kind == "string" else F.col(c).isNull()


def enrich(live: DataFrame, backup: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """live with blank fields filled from the backup row of the same key."""
    kinds = dict(live.dtypes)
    other = backup.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    joined = live.join(other, F.col(key) == F.col("_k"), "left")
    filled = {f: F.when(_blank(f, kinds[f]), F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in fields}
    return joined.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in live.columns))


def merge_from_source(current: DataFrame, incoming: DataFrame, previous: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Three-way merge: a field follows the source where it still equals the last import; on a first import only where it is
    blank. Rows that the source lacks stay."""
    kinds = dict(current.dtypes)
    inc = incoming.select(F.col(key).alias("_i"), *(F.col(f).alias(f"_i_{f}") for f in fields))
    prev = previous.select(F.col(key).alias("_p"), *(F.col(f).alias(f"_p_{f}") for f in fields))
    joined = current.join(inc, F.col(key) == F.col("_i"), "left").join(prev, F.col(key) == F.col("_p"), "left")

    def field(f: str) -> Column:
        empty = F.col(f).isNull() | (F.size(f) == 0 if kinds[f].startswith("array") else F.col(f).cast("string") == "")
        follows = F.when(F.col("_p").isNotNull(), F.col(f).eqNullSafe(F.col(f"_p_{f}"))).otherwise(empty)
        return F.when(F.col("_i").isNotNull() & follows, F.col(f"_i_{f}")).otherwise(F.col(f))

    return joined.select(*(field(c).alias(c) if c in fields else F.col(c) for c in current.columns))


def same_core(a: str, b: str) -> Column:
    """Title, journal, year, DOI and ordered authors equal, after trimming to null."""
    pairs = [T.trim_to_null(F.col(f"{a}.{f}")).eqNullSafe(T.trim_to_null(F.col(f"{b}.{f}"))) for f in ("title", "journal", "year", "doi")]
    authors = F.transform(f"{a}.authors", T.trim_to_null).eqNullSafe(F.transform(f"{b}.authors", T.trim_to_null))
    return reduce(lambda x, y: x & y, pairs, authors)


def change_status(current: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """Of rows with fingerprints content, meta and files: added, content, meta, files (in this order), or synced."""
    old = snapshot.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in ("content", "meta", "files")))
    joined = current.join(old, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col("_k").isNull(), "added")
    for c in ("content", "meta", "files"):
        status = status.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c)
    return joined.select(key, status.otherwise("synced").alias("status"))


def bigrams(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Character bigrams of a text with their counts, and how many there are in all."""
    n = F.length(value)
    gram = F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(F.col(value), i, F.lit(2))))
    exploded = rows.filter(n >= 2).select(F.col(key).alias("key"), (n - 1).alias("total"), gram.alias("gram"))
    return exploded.groupBy("key", "total", "gram").agg(F.count("*").alias("n"))


def best_matches(queries: DataFrame, candidates: DataFrame, threshold: float = 0.55) -> DataFrame:
    """For each query (key, title) the candidate of the largest Dice coefficient of bigram multisets, at least threshold; of
    equals that of the smallest key.

    A text's tokens are its bigrams, a repeated one numbered, sorted by how rare they are. Two texts whose coefficient reaches t
    have t / (2 - t) of the longer one's tokens in common, so they share one of the rarest n - ceil(n t / (2 - t)) + 1 tokens of
    either: only texts that meet in such a prefix, and whose lengths allow it, are compared. Common bigrams are in few prefixes.
    Rows of equal texts are one text until the end, so copies of a title cost neither bigrams nor pairs.
    """
    asked = queries.select(F.col("key").alias("query"), T.search_form(F.col("title")).alias("t")).filter("query IS NOT NULL")
    offered = candidates.select("key", T.search_form(F.col("title")).alias("t")).filter("key IS NOT NULL")
    # One row a text, however many queries and candidates bear it.
    forms = asked.select("t", F.lit(True).alias("asked"), F.lit(None).cast(dict(candidates.dtypes)["key"]).alias("match")).unionByName(offered.select("t", F.lit(None).cast("boolean").alias("asked"), F.col("key").alias("match")))
    forms = stored(forms.groupBy("t").agg(F.max("asked").alias("asked"), F.min("match").alias("match")), "forms")
    grams = stored(bigrams(forms, "t", "t"), "bigrams")
    rarity = grams.groupBy("gram").agg(F.sum("n").alias("often"))
    token = F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct("often", "gram", i.alias("nth"))))
    texts = grams.join(rarity, "gram").select("key", "total", token.alias("token")).groupBy("key", "total").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    texts = stored(forms.join(texts, F.col("t") == F.col("key")).select("t", "asked", "match", "total", "tokens"), "tokens")
    prefix = F.slice("tokens", F.lit(1), F.col("total") - F.ceil(F.col("total") * threshold / (2 - threshold) - 1e-9).cast("int") + 1)
    met = texts.select("t", "asked", "match", "total", F.explode(prefix).alias("token")).select("t", "asked", "match", "total", "token.gram", "token.nth")
    a, b = met.filter("asked").alias("a"), met.filter("match IS NOT NULL").alias("b")
    same = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.nth") == F.col("b.nth"))
    near = 2 * F.least("a.total", "b.total") >= threshold * (F.col("a.total") + F.col("b.total")) - 1e-9
    pairs = a.join(b, same).filter(near).select(F.col("a.t").alias("u"), F.col("b.t").alias("v")).distinct()
    left, right = (texts.select(F.col("t").alias(name), F.col("match").alias(f"m_{name}"), F.col("total").alias(f"n_{name}"), F.col("tokens").alias(f"t_{name}")) for name in ("u", "v"))
    common = F.size(F.array_intersect("t_u", "t_v"))
    scored = pairs.join(left.drop("m_u"), "u").join(right, "v").select("u", F.col("m_v").alias("match"), (2 * common / (F.col("n_u") + F.col("n_v"))).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("u").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("m"))
    return asked.join(best, F.col("t") == F.col("u")).groupBy("query").agg(F.min("m").alias("m")).select("query", F.col("m.match").alias("match"), (-F.col("m.s")).alias("score"))
