"""Small relational operations on library tables: lookups, deletes, merges of cached cells, counts, orders, sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

# Files and folders of a document that a data-only backup leaves out.
DERIVED_FILES = ("source.pdf", "extract.raw.md", "extract.md", "extract.json", "extract.paddleocr.json", "extract.paddleocr.raw.md",
                 "extract.mineru.json", "extract.mineru.raw.md", "mineru.exports.zip")
DERIVED_FOLDERS = ("figures", "summary")


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key, or none. The filter reaches the scan of a stored table."""
    return rows.filter(F.col(key) == F.lit(value))


def by_content(incoming: DataFrame, existing: DataFrame, content: str, key: str) -> DataFrame:
    """incoming with column known: the smallest key of an existing row of the same content hash, null if it is new."""
    first = existing.filter(F.col(content).isNotNull()).groupBy(F.col(content).alias("_c")).agg(F.min(key).alias("known"))
    return incoming.join(first, F.col(content) == F.col("_c"), "left").drop("_c")


def without_groups(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose group (document and group id, say) is not in gone; a row with a null in its keys belongs to no group."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def merged_cells(old: DataFrame, new: DataFrame, by: list[str], cells: str) -> DataFrame:
    """Maps of cells (by document and language, say): new cells win over old ones of the same key, all others are kept."""
    a = old.select(*by, F.col(cells).alias("_old"))
    b = new.select(*by, F.col(cells).alias("_new"))
    empty = F.create_map().cast(dict(new.dtypes)[cells])
    before, after = F.coalesce("_old", empty), F.coalesce("_new", empty)
    kept = F.map_filter(before, lambda k, _: ~F.array_contains(F.map_keys(after), k))
    return a.join(b, by, "full").select(*by, F.map_concat(kept, after).alias(cells))


def storage_group(path: Column) -> Column:
    """The group that clears a library file: chat, cache (rendered pages), or papers."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == ".reader.html", "cache").when(F.startswith(path, F.lit("chats/")), "chat").otherwise("papers")


def cleared(files: DataFrame, path: str, groups: tuple[str, ...]) -> DataFrame:
    """Files of groups that are not cleared."""
    return files.filter(~storage_group(F.col(path)).isin(*groups))


def in_data_backup(path: Column) -> Column:
    """Whether a data-only backup has a file of the library: not the PDF and what was extracted from it, nor derived folders."""
    parts = F.split(path, "/")
    second = F.get(parts, F.lit(1))
    return F.when(F.size(parts) < 2, True).when(F.size(parts) == 2, ~second.isin(*DERIVED_FILES)).otherwise(~second.isin(*DERIVED_FOLDERS))


def model(rows: DataFrame, lists: tuple[str, ...], times: tuple[str, ...]) -> DataFrame:
    """Stored rows as models: JSON lists as arrays (bad JSON: empty), epoch milliseconds as timestamps."""
    out = {c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in lists}
    return rows.withColumns(out | {c: F.timestamp_millis(F.col(c)) for c in times})


def split_by_file(docs: DataFrame, content: str = "contentHash") -> tuple[DataFrame, DataFrame]:
    """Documents with a file, and those without."""
    return docs.filter(F.col(content).isNotNull()), docs.filter(F.col(content).isNull())


def selectable(docs: DataFrame, wanted: Column, linked: DataFrame, key: str) -> DataFrame:
    """Documents that pass a filter and are not linked yet (linked: one column of ids)."""
    return docs.filter(wanted).join(linked.toDF("_k").distinct(), F.col(key) == F.col("_k"), "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables in one result."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def rebuild_counts(docs: DataFrame) -> DataFrame:
    """One row: documents without a file, and those with a file whose fields still need repair."""
    fields = [F.col(c) for c in ("id", "title", "authors", "year", "journal", "doi", "contentHash")]
    return docs.agg(F.count_if(F.col("contentHash").isNull()).alias("no_file"), F.count_if(F.coalesce(T.needs_repair(*fields), F.lit(False))).alias("unresolved"))


def total(sections: DataFrame, size: str) -> DataFrame:
    return sections.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"))


def last_in_first_place(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each key once: its last value, and the place where it stood first (what writing rows into an ordered map leaves)."""
    return rows.groupBy(key).agg(F.min(order).alias(order), F.max_by(value, order).alias(value))


def union_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The smallest box around the boxes of each group."""
    return boxes.groupBy(*by).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def by_added(rows: DataFrame, at: str, tie: str) -> DataFrame:
    return rows.orderBy(F.asc(at), F.asc(tie))


def default_first(rows: DataFrame, key: str, at: str, default: str = "_default_") -> DataFrame:
    """The default row, then the others by when they were made."""
    return rows.orderBy(F.desc(F.col(key) == default), F.asc(at), F.asc(key))


def kept_only(rows: DataFrame, foreign_key: str, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in the kept set (one column), and those to be deleted; a null key is in no set."""
    k = kept.toDF("_k").distinct()
    same = F.col(foreign_key) == F.col("_k")
    return rows.join(k, same, "left_semi"), rows.join(k, same, "left_anti")


def backup_due(current: DataFrame, snapshot: DataFrame, taken: Column, now: Column, seconds: int, key: str = "id") -> DataFrame:
    """One row (due): the interval has passed, and a row was added or removed or one of its fingerprints differs. No snapshot: due."""
    prints = ("content", "meta", "files")
    old = snapshot.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in prints))
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in prints], F.col("_k").isNull() | F.col(key).isNull())
    changed = current.select(key, *prints).join(old, F.col(key) == F.col("_k"), "full").agg(F.coalesce(F.bool_or(differs), F.lit(False)).alias("changed"))
    passed = taken.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(taken) >= seconds)
    return changed.select((taken.isNull() | (passed & F.col("changed"))).alias("due"))


def extraction_source(docs: DataFrame, named: DataFrame, wanted: Column) -> DataFrame:
    """Per document (doc, active) the file to read for the wanted source: its own (named: doc, source, path) if there is one, else the
    unnamed one (path null) if the active source is the wanted one; a problem otherwise."""
    n = named.select(F.col("doc").alias("_d"), F.col("source").alias("_s"), "path")
    rows = docs.withColumn("wanted", wanted)
    joined = rows.join(n, (F.col("doc") == F.col("_d")) & (F.col("wanted") == F.col("_s")), "left")
    active = F.coalesce("active", F.lit("paddle"))
    problem = F.when(F.col("path").isNull() & (active != F.col("wanted")), "extraction_source_not_found")
    return joined.select("doc", "wanted", "path", problem.alias("problem"))


def unreferenced(generations: DataFrame, references: DataFrame) -> DataFrame:
    """Generated folders (doc, folder) that no referenced path (doc, path) is or lies in."""
    # The path itself and what stands before each of its slashes, so the join is on equal keys, not on all pairs of a doc.
    parts = F.split("path", "/", -1)
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    inside = references.filter("path IS NOT NULL").select("doc", above.alias("folder")).distinct()
    return generations.join(inside, ["doc", "folder"], "left_anti")


def repaired_by_background(snapshot: DataFrame, current: DataFrame, repaired: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """A field that still is what it was when the repair began takes the repaired value; what has been edited since stays."""
    s = snapshot.select(F.col(key).alias("_s"), *(F.col(f).alias(f"_s_{f}") for f in fields))
    r = repaired.select(F.col(key).alias("_r"), *(F.col(f).alias(f"_r_{f}") for f in fields))
    joined = current.join(s, F.col(key) == F.col("_s"), "left").join(r, F.col(key) == F.col("_r"), "left")
    both = F.col("_s").isNotNull() & F.col("_r").isNotNull()
    new = {f: F.when(both & F.col(f).eqNullSafe(F.col(f"_s_{f}")), F.col(f"_r_{f}")).otherwise(F.col(f)).alias(f) for f in fields}
    return joined.select(*(new.get(c, F.col(c)) for c in current.columns))


def snapshot_problems(tables: dict[str, DataFrame], expected: dict[str, tuple[str, ...]], version: int, newest: int, foreign: dict[tuple[str, str], tuple[str, str]],
                      allow_orphans: bool = False) -> list[str]:
    """What stops a snapshot from being restored: its version, tables or columns that are missing, child rows without a parent
    (foreign: child table and column to parent table and column). One existence check a relation."""
    found = ["invalid version"] if version <= 0 else ["unsupported version"] if version > newest else []
    for name, columns in expected.items():
        if name not in tables:
            found.append(f"no table {name}")
        found += [f"no column {name}.{c}" for c in columns if name in tables and c not in tables[name].columns]
    for (child, column), (parent, key) in foreign.items() if not found and not allow_orphans else ():
        k = tables[parent].select(F.col(key).alias("_k"))
        if not tables[child].filter(F.col(column).isNotNull()).join(k, F.col(column) == F.col("_k"), "left_anti").isEmpty():
            found.append(f"orphans in {child}.{column}")
    return found


def result_list(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Search results (title, url, text) of each query as one numbered text."""
    one = F.array_sort(F.collect_list(F.struct(order, "title", "url", "text")))

    def line(r: Column, i: Column) -> Column:
        part = [F.coalesce(r[c], F.lit("")) for c in ("title", "url", "text")]
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), part[0], F.lit("\nURL: "), part[1], F.lit("\n"), part[2])

    return rows.groupBy(by).agg(one.alias("r")).select(by, F.array_join(F.transform("r", line), "\n\n").alias("listing"))


def filtered_ids(rows: DataFrame, key: str, flags: tuple[str, ...], query: str) -> DataFrame:
    """Rows with all the flags whose key contains the query, letters folded; an empty query is in all."""
    return reduce(lambda d, f: d.filter(F.coalesce(f, F.lit(False))), flags, rows).filter(F.contains(F.lower(key), F.lit(query.lower())))


def latest_snapshot(items: DataFrame, meta: DataFrame, key: str, version_key: str) -> DataFrame:
    """Items with the library's version cursor beside them (0 where it is missing or no number)."""
    cursor = meta.filter(F.col("metaKey") == version_key).agg(F.max(F.expr("try_cast(value AS BIGINT)"))).first()[0]  # one number
    newest = Window.partitionBy(key).orderBy(F.desc("version"))
    return items.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n").withColumn("library_version", F.lit(cursor or 0).cast("long"))
