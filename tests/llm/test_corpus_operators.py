"""Selection, near-duplicates, decontamination, personal data, shards, WARC and the pipeline against plain Python."""

import hashlib
import io
import random
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import test_quality
from paperloom.llm import decontaminate, pii, quality, shards, simhash, warc
from paperloom.operators.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(values):
    """For each value the smallest index of its component at 4 bits or fewer."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_near_duplicates_equal_brute_force(odd, odd_rows, empty):
    got = simhash.near_duplicates(odd).collect()
    prints = [fingerprint(r[1]) for r in odd_rows]
    groups = classes(prints)
    smallest = {}
    for r, g in zip(odd_rows, groups, strict=True):
        smallest[g] = min((x for x in (smallest.get(g), r[0]) if x is not None), default=None)
    want = Counter((r[0], p, smallest[g]) for r, p, g in zip(odd_rows, prints, groups, strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays(odd, odd_rows, empty):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    groups = classes([fingerprint(r[1]) for r in odd_rows])
    assert kept.count() == len(set(groups))
    assert len(set(classes([fingerprint(r.text) for r in kept.collect()]))) == kept.count()
    assert simhash.deduplicated(empty).count() == 0


@pytest.mark.parametrize(("slice_size", "slices"), [(4096, 64), (16, 64), (8, 2)])
def test_links_keep_every_component(spark, monkeypatch, slice_size, slices):
    """Random fingerprints, dense balls and chains; with tiny slices hot buckets are dealt out as pairs of slices, or bucketed again."""
    monkeypatch.setattr(simhash, "SLICE", slice_size)
    monkeypatch.setattr(simhash, "MAX_SLICES", slices)
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(200)} | {0}
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    at = rng.getrandbits(64)
    for _ in range(60):
        for _ in range(4):
            at ^= 1 << rng.randrange(64)
        values.add(at)
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values] * 2, "fp long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(fps)).collect()}
    want = classes(values)
    got = [roots.get(v, v) for v in values]
    assert Counter(Counter(got).values()) == Counter(Counter(want).values())
    assert len(set(zip(got, want, strict=True))) == len(set(want))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(n, n + 1) for n in range(300)] + [(1000, n) for n in range(1001, 1400)] + [(5, 5), (None, 3)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {n: 0 for n in range(1, 301)} | {n: 1000 for n in range(1001, 1400)}


def test_majority_counts_beyond_one_counter():
    h = np.concatenate([np.full(70_000, 5, np.uint64), np.full(69_999, 2, np.uint64), np.full(3, 1, np.uint64)])
    assert simhash._majority(h, np.array([139_999, 0, 3])).tolist() == [5, 0, 1]


def contaminated(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        for i in range(max(0, len(w) - 10) + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = Counter()
    for doc, text in docs:
        w = word.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (names := windows.get(tuple(w[i : i + m]))):
                    hit |= set(range(i, i + m))
                    found |= names
        out[(doc, len(w), len(hit), tuple(sorted(found)))] += 1
    return out


def test_contamination_equals_brute_force(spark, odd, odd_rows, empty):
    long = odd_rows[10][1].split(" ")
    items = [(1, " ".join(long[50:75])), (2, "ONE"), (3, None), (4, "..."), (None, " ".join(long[100:120])), (5, " ".join(long[0:3])), (10, " ".join(long[60:70])), (10, " ".join(long[60:70])), (6, "same line here same line")]
    bench = spark.createDataFrame([(*i, "extra") for i in items], "item_id long, text string, id string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.contamination(odd, bench).collect())
    want = contaminated([r[:2] for r in odd_rows], items)
    assert got == want and any(k[2] for k in want)
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r[:2] for r in odd_rows if not next(iter(contaminated([r[:2]], items)))[2])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(odd, bench.limit(0)).collect())


def test_a_frequent_gram_joins_only_shared_windows(spark):
    """Items and documents that all have the same five words but different words around them: no row for a pair of them."""
    core = "in the following text find"
    item = lambda n, tag: " ".join(f"{tag}{n}x{k}" for k in range(6)) + f" {core} " + " ".join(f"{tag}{n}y{k}" for k in range(6))
    docs = spark.createDataFrame([(n, item(n, "d")) for n in range(60)] + [(99, "so " + item(7, "i") + " end")], "doc_id long, text string")
    bench = spark.createDataFrame([(n, item(n, "i")) for n in range(60)], "item_id long, text string")
    rows, hits, _ = decontaminate._printed_and_hits(docs, bench, "doc_id", "text", "item_id", "text")
    assert hits.select("row").distinct().count() == 1
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.contamination(docs, bench).collect() if r.n_hit}
    assert got == {99: ["7"]}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=5), st.lists(st.text(alphabet="ab ", max_size=40), min_size=1, max_size=4))
def test_contamination_of_tiny_alphabets(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.contamination(d, b).collect())
    assert got == contaminated(enumerate(docs), list(enumerate(items)))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    def ok(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        return luhn(digits) if kind == "card" and 12 <= len(digits) <= 19 else kind == "email" or kind == "phone" and 9 <= len(digits) <= 15

    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    return sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(patterns) for m in re.finditer(p, text or "") if ok(k, m.group()))


TRICKY = ["a@b.c_d@e.f", "..a@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 00010.0.0.1", "+1 (555) 123-4567+44 20 7946 0958", "4111-1111 1111-1111 4111111111111112", "😀 x@y.zz é 10.0.0.1", "+12345678 +123456789012345678",
          "1" * 9000, "9" * 40 + "@x", "a" * 9000 + "@b.co", "1 2 3 " * 3000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]


def test_base_spans_equal_python(spark, odd, odd_rows, empty):
    texts = [r[1] for r in odd_rows] + TRICKY
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.rank, s.end) for s in r.base] for r in pii.detect(docs).collect()}
    assert got == {n: base_spans(t) for n, t in enumerate(texts)}
    assert pii.detect(odd).count() == len(odd_rows) and pii.detect(empty).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+ -(5", max_size=60), min_size=1, max_size=20))
def test_base_spans_of_tiny_alphabets(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.rank, s.end) for s in r.base] for r in docs.select("doc_id", pii.base_spans(F.col("text")).alias("base")).collect()}
    assert got == {n: base_spans(t) for n, t in enumerate(texts)}


def test_contexts_discover_unseen_identifiers(spark):
    """Card numbers after the same words as valid ones are found though their check digit is wrong; others are not."""
    rng = random.Random(2)

    def number(valid):
        while luhn(n := "4" + "".join(rng.choice("0123456789") for _ in range(15))) != valid:
            pass
        return n

    rows = [(n, f"please charge card {number(True)} today for the order") for n in range(40)]
    rows += [(100, f"please charge card {number(False)} today for the order"), (101, f"serial code {number(False)} printed here"), (102, f"serial code {number(False)} printed there")]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.rank, s.end) for s in got[100].spans] == [(19, 2, 35)] and not got[100].base
    assert not got[101].spans and not got[102].spans
    assert all(got[n].spans == got[n].base for n in range(40))


def test_redaction(spark, odd, odd_rows):
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    assert next(r.text for r in out.collect() if r.doc_id == 10) == "mail <EMAIL> or <PHONE>, host <IP>, card <CARD>\nx"
    assert sum(r.text is None for r in out.collect()) == 2
    mixed = spark.createDataFrame([(1, "+4111111111111111 a")], "doc_id long, text string")  # a card within a phone's signs
    assert pii.redacted(mixed).first().text in ("<PHONE> a", "+<CARD> a")


def test_shards_follow_the_law(spark, odd, odd_rows, empty):
    rows = shards.interleave(odd, 4).collect()
    assert len(rows) == len(odd_rows)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in odd_rows)
    assert shards.interleave(empty, 4).count() == 0


@pytest.mark.parametrize("bucket_rows", [500, 20])
def test_shards_match_the_mixture_and_brute_force(spark, monkeypatch, bucket_rows):
    import zlib

    monkeypatch.setattr(shards, "BUCKET_ROWS", bucket_rows)
    data = [(n, f"text {n % 97}", ["big", "mid", f"tiny{n}", None][0 if n % 3 else 1 if n % 2 else 2 if n % 12 else 3]) for n in range(1200)]
    rows = shards.interleave(spark.createDataFrame(data, "doc_id long, text string, source string"), 24).collect()
    for source in ("big", "mid"):
        counts = Counter(r.shard for r in rows if r.source == source)
        assert max(counts.values()) - min(counts.values()) <= 2

    def unit(h):
        return int(h[:8], 16) / (1 << 32)

    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()

    ranked, strata, rows_of = [], {}, Counter(s for *_, s in data)
    for i, t, s in data:
        stratum = "" if s is None else "=" + s if rows_of[s] >= 24 else "*"
        strata.setdefault(stratum, []).append((md5(f"0|{i}|{zlib.crc32(t.encode())}"), i))
    for stratum, members in strata.items():
        ranked += [((n + 1 - unit(md5(stratum))) / len(members), stratum, h, i) for n, (h, i) in enumerate(sorted(members))]
    order = [i for *_, i in sorted(ranked)]
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == order


def test_warc_round_trip(spark, empty):
    big, small = "<p>" + "x" * 2000 + "é</p>", "tiny"
    data = [(1, "http://a/b c", big), (5, "http://a/\r\ninject: x", big), (5, "u", big), (None, "u", big), (2, None, small), (3, "u", small), (4, "u", None), (6, "u", "line\r\n\r\nline"), (7, "u", "y" * 999), (8, "u", "y" * 999), (9, "u", "z" * 50_000)]
    pages = spark.createDataFrame([(*d, "clash") for d in data], "page_id long, url string, html string, payload string").repartition(3)
    rows = warc.round_trip(pages, with_payload=True).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    want = Counter()
    for page, _, html in data:
        body = (html or "").encode()
        revisit = html == big and page != 5
        want[(page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)] += 1
    assert got == want
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in data}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_packages_without_index_and_with_many_packages(spark, tmp_path):
    pages = spark.createDataFrame([(n, f"http://h/{n}", f"page {n} " + "".join(random.Random(n).choices("abcdef", k=3000))) for n in range(30)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    packages = warc.write_packages(pages, folder, package_bytes=2000)
    assert packages.count() > 10 and {r.page_id for r in warc.read_packages(packages).collect()} == set(range(30))
    path = packages.first().path.removeprefix("file://")
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(f"{path}.bare", "w") as bare:
        records = len(z.read(warc.INDEX).splitlines())
        bare.writestr(warc.MEMBER, z.read(warc.MEMBER))
    alone = spark.createDataFrame([(f"file://{path}.bare",)], "path string")
    assert warc.read_packages(alone).count() == records


def repacked(path, out, change):
    """A copy of a package whose members (name, content, compression) are those that change makes of the old ones."""
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(out, "w") as new:
        for name, content, method in change({n: old.read(n) for n in old.namelist()}):
            new.writestr(zipfile.ZipInfo(name), content, method)


STORED, DEFLATED, BZIP2 = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2


@pytest.mark.parametrize("change", [
    lambda m: [(warc.MEMBER, m[warc.MEMBER], DEFLATED), (warc.INDEX, m[warc.INDEX], DEFLATED)],
    lambda m: [(warc.MEMBER, m[warc.MEMBER], DEFLATED)],
    lambda m: [(warc.MEMBER, m[warc.MEMBER], STORED), (warc.INDEX, m[warc.INDEX], DEFLATED)],
    lambda m: [(warc.MEMBER, m[warc.MEMBER], STORED), (warc.INDEX, b"!meta\n" + b"\n".join(m[warc.INDEX].splitlines()[3:-2:2]), STORED)],
    lambda m: [("archive/other.warc.gz", m[warc.MEMBER], STORED), ("indexes/a.cdx", b"", STORED), ("pages/p.jsonl", b"x", STORED)],
    lambda m: [("archive/plain.warc", b"".join(warc._records(iter([m[warc.MEMBER]]))), STORED), ("archive/two.warc.gz", b"", STORED)],
    lambda m: [("archive/plain.warc", b"".join(warc._records(iter([m[warc.MEMBER]]))), DEFLATED)]])
def test_no_record_is_lost_however_a_package_is_packed(spark, tmp_path, change):
    rng = random.Random(1)
    pages = spark.createDataFrame([(n, f"http://h/{n}", f"page {n} " + "".join(rng.choices("abcdefé", k=rng.randrange(1, 4000)))) for n in range(24)], "page_id long, url string, html string").coalesce(1)
    (package,) = warc.write_packages(pages, f"file://{tmp_path}/w").collect()
    out = f"{tmp_path}/new.zip"
    repacked(package.path.removeprefix("file://"), out, change)
    rows = warc.read_packages(spark.createDataFrame([(f"file://{out}", 1), (f"file://{out}", 2), (None, 3)], "path string, offset int")).collect()
    assert Counter((r.page_id, r.url, bytes(r.payload).decode()) for r in rows) == Counter(tuple(r) for r in pages.collect())


@pytest.mark.parametrize(("change", "said"), [
    (lambda m: [(warc.MEMBER, m[warc.MEMBER], BZIP2)], "packed by method 12"),
    (lambda m: [(warc.MEMBER, m[warc.MEMBER][:-9], STORED)], "member archive/data.warc.gz"),
    (lambda m: [(warc.MEMBER, m[warc.MEMBER], STORED), (warc.INDEX, b'x {"filename": "gone.warc.gz", "offset": 0, "length": 3}', STORED)], "gone.warc.gz"),
    (lambda m: [(warc.MEMBER, m[warc.MEMBER], STORED), (warc.INDEX, b'x {"offset": 5, "length": 300000}', STORED)], "outside of"),
    (lambda m: [(warc.MEMBER, b"no record at all, no", STORED)], "member archive/data.warc.gz")])
def test_damage_is_an_error_that_names_the_package(spark, tmp_path, change, said):
    pages = spark.createDataFrame([(n, "u", f"page {n}") for n in range(3)], "page_id long, url string, html string").coalesce(1)
    (package,) = warc.write_packages(pages, f"file://{tmp_path}/w").collect()
    out = f"{tmp_path}/new.zip"
    repacked(package.path.removeprefix("file://"), out, change)
    with pytest.raises(Exception, match=said) as e:
        warc.read_packages(spark.createDataFrame([(f"file://{out}",)], "path string")).collect()
    assert "new.zip" in str(e.value)


def test_unreadable_paths_and_other_records(spark, tmp_path):
    (tmp_path / "junk.zip").write_bytes(b"this is no archive")
    for name in ("junk.zip", "missing.zip"):
        with pytest.raises(Exception, match=name):
            warc.read_packages(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string")).collect()
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nabcd"
    page = warc._record(None, "http://x", b"body", hashlib.sha1(b"body").hexdigest(), None).replace(b"<urn:page:>", b"<urn:uuid:2>")
    with zipfile.ZipFile(tmp_path / "foreign.zip", "w") as z:
        z.writestr("archive/a.warc", info + b"\r\n\r\n" + page)
    (row,) = warc.read_packages(spark.createDataFrame([(f"file://{tmp_path}/foreign.zip",)], "path string")).collect()
    assert (row.page_id, row.url, bytes(row.payload)) == (None, "http://x", b"body")


def test_zip64_directory():
    """Sizes, offset and entry count that only the ZIP64 records hold."""
    name, data, comment = b"archive/data.warc.gz", b"payload!", b"PK\x05\x06 is not here"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    at = len(b"junk") + len(local) + len(data)
    extra = struct.pack("<HH", 9, 2) + b"zz" + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 4)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    blob = b"junk" + local + data + central + wide + locator + end
    del comment

    def read_at(offset, length):
        return blob[offset : offset + length]

    (member,) = warc.directory(read_at, len(blob))
    start = warc.data_offset(read_at, member)
    assert (member["plain"], read_at(start, member["packed"])) == (len(data), data)
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", b"1")
        z.writestr("b", b"22")
    blob = plain.getvalue()
    assert [(m["name"], m["plain"]) for m in warc.directory(read_at, len(blob))] == [("a", 1), ("b", 2)]


def test_quality_selection(spark, odd, odd_rows, empty):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    chosen = quality.select(docs, labels)
    scores = chosen.scores()
    judged = scores.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in judged}
    assert kept[(1, 0)] > 0.97 and kept[(0, 0)] < 0.05 and kept[(1, 1)] < 0.3
    assert chosen.kept(docs).columns == docs.columns
    assert {r.doc_id for r in chosen.kept(docs).select("doc_id").collect()} == {r.doc_id for r in scores.filter("kept").collect()}
    labels_of_odd = spark.createDataFrame([(1, 1, 0, 5), (1, 1, None, 5), (11, 0, 0, 5), (12, None, 1, 5), (None, 1, 0, 5), (99, 0, 1, 5)], "doc_id long, quality int, toxic int, weight int")
    odd_choice = quality.select(odd, labels_of_odd)
    assert odd_choice.scores().count() == len(odd_rows)
    assert not any(r.kept for r in odd_choice.scores().collect() if r.log_weight is None)
    assert all(r.kept for r in quality.select(odd, labels_of_odd.limit(0)).scores().collect() if r.log_weight is not None)
    assert quality.select(empty, labels_of_odd).scores().count() == 0


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(15_000)] + [0.5] * 12_000
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 7, 5_000, 12_000, 27_000):
        assert quality.kth_largest(rows, "x", k) == ordered[k - 1]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Each stage judged on its own input at the smallest size."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            ids = sorted(before)
            groups = classes([fingerprint(before[i].text) for i in ids])
            assert set(after) == {ids[g] for g in groups}
        elif name == "decontamination":
            assert set(after) == {d for d, r in before.items() if not next(iter(contaminated([(d, r.text)], items)))[2]}
        elif name == "personal_data":
            assert set(after) == set(before)
            assert all((after[d].text == r.text) == (not base_spans(r.text)) for d, r in before.items())
            assert not any(base_spans(r.text) for r in after.values())
        elif name == "tokens":
            assert set(after) == set(before)
            assert all(hashlib.sha256(before[d].text.encode()).hexdigest() == r.decoded_sha256 for d, r in after.items())
            plain = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
            assert all(list(r.ids) == plain.encode(before[d].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for d, r in after.items())
        else:
            assert docs.columns == list(spark.read.parquet(f"{sf}/documents.parquet").columns)
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            chosen = quality.select(spark.read.parquet(f"{sf}/documents.parquet"), labels)
            good = {r.doc for r in quality.labelled_sample(labels, "doc_id", "quality", "toxic").collect() if r.good and not r.held_out}
            ids = sorted(before)
            weights = test_quality.log_weights([(d, before[d].text) for d in ids], good)
            noise = {r.doc_id: r.g for r in spark.createDataFrame([(d,) for d in ids], "doc_id long").select("doc_id", quality.gumbel(F.col("doc_id"), 0).alias("g")).collect()}
            keys = {d: w + noise[d] for d, w in zip(ids, weights, strict=True) if w is not None}
            k = sum(w is not None and w >= chosen.threshold for w in weights)
            assert set(after) == set(sorted(keys, key=keys.get, reverse=True)[:k])
