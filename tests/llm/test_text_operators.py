"""Token, word and language operators against plain Python."""

import hashlib
import json
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import bpe, hostrules, language, pii, token_counts, warc
from paperloom.llm import words as W

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoding_equals_the_tokenizers_library(odd, odd_rows, tokenizer):
    got = sorted((r.doc_id is None, r.doc_id, list(r.ids), r.decoded) for r in bpe.encode(odd, PATH).collect())
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id is None, doc_id, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_encoding_of_nothing(empty):
    assert bpe.encode(empty, PATH).count() == 0


PIECES = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(["  ", "\n\n", " the", "'", "'re", "ll", "<|endoftext|>", "<|end", "text|>", "é", "中文字", "数据", "。", "1", "99", "...", "word"]))


def alone(own, raw):
    ids = own.encoded(raw)
    sure = [p for p in own.boundaries(raw) if p <= len(raw) - own.margin]
    last = sure[-1] if sure else 0
    return ids, last, int(np.searchsorted(np.cumsum(own.sizes[ids]), last, "right"))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=120).map("".join), st.lists(st.integers(0, 3000), max_size=8))
def test_joins_are_repaired_whatever_the_cuts(tokenizer, text, at):
    """Chunks cut anywhere, not at certain boundaries, each encoded on its own: what is put together equals the library's ids."""
    own = bpe.vocabulary(PATH)
    raw = text.encode()
    edges = sorted({0, len(raw), *(p for p in at if p < len(raw) and raw[p] & 0xC0 != 0x80)})
    places = [(a, b, n) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if n % 3 != 2]
    known = {n: alone(own, raw[a:b]) for a, b, n in places}
    ids, reused = bpe.assembled(own, raw, places, known)
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and 0 <= reused <= len(raw)
    assert own.decode(ids) == text


def test_a_chunk_under_anothers_hash_is_not_used():
    own = bpe.vocabulary(PATH)
    raw = ("some words in a row " * 20).encode()
    ids, reused = bpe.assembled(own, raw, [(0, 200, 7)], {7: alone(own, b"x" * 200)})
    assert reused == 0 and own.decode(ids).encode() == raw


@pytest.mark.parametrize("unit", ["Some words that many texts share, one after another. ", "数据处理的方法很多。我们在这里说明其中的一种，并且比较结果。"])
def test_shared_chunks_are_reused(spark, tokenizer, unit):
    rng = random.Random(4)
    shared = "".join(unit[rng.randrange(len(unit)) :] + str(rng.randrange(999)) for _ in range(200))
    docs = [(n, f"begins {n} alone" + shared[n * 7 :] + f"{n} ends") for n in range(5)] + [(9, "nothing in common")]
    rows = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()}
    assert all(list(rows[n].ids) == tokenizer.encode(t, add_special_tokens=False).ids and rows[n].decoded == t for n, t in docs)
    assert rows[9].reused_bytes == 0 and all(rows[n].reused_bytes > 0.6 * len(t.encode()) for n, t in docs[:5])


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"decoder": None},
    {"model": {"type": "WordPiece"}}, {"model": {"type": "BPE", "byte_fallback": True}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]},
    {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}, "merges": ["a b", "b c"]}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    spec = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}, "decoder": {"type": "ByteLevel"}, "added_tokens": [], "model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({**spec, **change}))
    with pytest.raises(ValueError, match="can't be used"):
        bpe.Vocabulary(str(path))


def test_chunks_of_equal_stretches_are_cut_alike():
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ij") for _ in range(6000)).encode()
    a, b = (np.frombuffer(p + shared, np.uint8) for p in (b"one prefix ", b"another, longer prefix "))
    ends = [set((len(x) - bpe.cuts(x)).tolist()) for x in (a, b)]
    inner = {e for e in ends[0] | ends[1] if e < len(shared) - 32}
    assert inner and inner <= ends[0] & ends[1]


def test_edit_aware_counts(spark, odd, odd_rows, tokenizer):
    state = token_counts.build(odd, PATH)
    edits = [("3", 5, "'<b> '"), ("cast(null AS int)", 0, "'Neu: '"), ("100000", 10, "' end'"), ("40", 4000, "cast(null AS string)")]
    changes = "array(" + ", ".join(f"named_struct('start', {a}, 'length', {n}, 'replacement', {r})" for a, n, r in edits) + ")"
    got = token_counts.apply_edits(state, PATH, F.expr(changes))
    again = {(repr(r.doc_id), r.text): (r.n_tokens_before, r.n_tokens) for r in got.collect()}

    def edited(text):
        for start, length, new in ((3, 5, "<b> "), (0, 0, "Neu: "), (100000, 10, " end"), (40, 4000, "")):
            start = min(start, len(text))
            text = text[:start] + new + text[start + length:]
        return text

    def count(text):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    want = {(repr(r[0]), edited(r[1] or "")): (count(r[1] or ""), count(edited(r[1] or ""))) for r in odd_rows}
    assert again == want


def test_an_edit_re_encodes_little(spark):
    text = " ".join(f"word{n}" for n in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    edit = F.array(F.struct(F.lit(50_000).alias("start"), F.lit(3).alias("length"), F.lit("xyz").alias("replacement")))
    row = token_counts.apply_edits(token_counts.build(docs, PATH), PATH, edit).first()
    assert row.reencoded_bytes < 4 * token_counts.LEAF_BYTES


def test_many_edits_at_one_place_re_encode_little(tokenizer):
    own = bpe.vocabulary(PATH)
    raw = " ".join(f"word{n}" for n in range(3000)).encode()
    tree = token_counts.CountTree.built(raw, bpe.certain_boundaries(np.frombuffer(raw, np.uint8)), own.encode)
    most = 0
    for n in range(10_000):
        before = tree.reencoded
        tree.edit(5000, int(n % 3 == 0), "new words, " if n % 2 else "x y", own.encode)
        most = max(most, tree.reencoded - before)
    assert most <= 5 * token_counts.LEAF_BYTES and max(tree.size[tree.leaves :]) <= 3 * token_counts.LEAF_BYTES
    assert tree.tokens == len(tokenizer.encode(tree.text.decode(), add_special_tokens=False).ids)


def test_many_edits_of_a_long_text_cost_little_each(tokenizer):
    """Ten thousand edits all over a text of 4 MB: it is neither counted nor copied for each."""
    own, rng = bpe.vocabulary(PATH), random.Random(3)
    text = " ".join(rng.choice(["river", "stone,", "é", "light\n", "12"]) for _ in range(800_000))
    raw = text.encode()
    tree = token_counts.CountTree.built(raw, bpe.certain_boundaries(np.frombuffer(raw, np.uint8)), own.encode)
    began = time.perf_counter()
    for n in range(10_000):
        tree.edit(rng.randrange(len(text)), 3, "new" if n % 2 else " é ", own.encode)
    assert time.perf_counter() - began < 30
    assert tree.tokens == len(own.encode(tree.text.decode())) and tree.points[1] == len(text)


def test_null_edits_and_empty_tables(spark, empty, tokenizer):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    edits = F.expr("array(cast(null AS struct<start:int,length:int,replacement:string>), named_struct('start', 0, 'length', 3, 'replacement', 'four'))")
    state = token_counts.build(docs, PATH)
    row = token_counts.apply_edits(state, PATH, edits).first()
    assert row.text == "four two three" and row.n_tokens == len(tokenizer.encode(row.text, add_special_tokens=False).ids)
    assert token_counts.apply_edits(state, PATH, F.expr("cast(null AS array<struct<start:int,length:int,replacement:string>>)")).first().text == "one two three"
    assert token_counts.apply_edits(token_counts.build(empty, PATH), PATH, edits).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \nab1é.", max_size=900), st.lists(st.tuples(st.integers(0, 900), st.integers(0, 400), st.text(alphabet=" \nxé", max_size=8)), max_size=6))
def test_count_tree_follows_any_edits(text, edits):
    own = bpe.vocabulary(PATH)
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    tree = token_counts.CountTree.built(raw, bpe.certain_boundaries(data) if len(data) else data, own.encode)
    for start, length, new in edits:
        tree.edit(start, length, new, own.encode)
        start = min(start, len(text))
        text = text[:start] + new + text[start + length :]
    assert tree.text.decode() == text and tree.tokens == len(own.encode(text))


def measures_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_and_host_verdicts(odd, odd_rows, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = hostrules.judged(odd).collect()
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in rows), key=repr) == sorted(((r[0], *measures_of(r[1])) for r in odd_rows), key=repr)
    assert all(not (r.base_failed and r.kept) for r in rows)
    assert all(r.kept is (not r.base_failed) for r in rows if r.host is None)
    assert hostrules.judged(empty).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = "word " * 5 + " ".join(f"w{n}" for n in range(40)), "short"
    rows = [(n, bad if n % 10 else good, "spam") for n in range(400)] + [(1000 + n, good if n % 10 else bad, f"h{n % 20}") for n in range(400)] + [(5000, bad, "single"), (5001, good, "single")]
    got = {r.doc_id: r for r in hostrules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[n].kept for n in range(400))
    assert all(got[1000 + n].kept for n in range(400) if n % 10)
    assert got[5001].kept


def test_language_mixtures(spark, odd, empty):
    rng = random.Random(3)
    pools = {"aa": "banana papaya guava lalala mamama".split(), "bb": "strich pflicht schwer kurz wurst".split(), "cc": "yeon quoi oiseau beaux eux".split()}

    def text(lang, n):
        return " ".join(rng.choice(pools[lang]) + rng.choice(pools[lang]) for _ in range(n))

    train = spark.createDataFrame([(text(lang, 30), lang) for lang in pools for _ in range(30)] + [(None, "aa"), ("x", None)], "text string, lang string")
    model = language.Model(train)
    assert model.languages == ["aa", "bb", "cc"]
    docs = [(n, text("aa", 30)) for n in range(5)] + [(10, text("aa", 60) + " " + text("bb", 30)), (11, None), (12, "123 ..."), (13, ""), (14, text("cc", 1))]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert [got[n].lang_pred for n in (*range(5), 10, 11, 12, 13, 14)] == ["aa"] * 6 + ["und"] * 3 + ["cc"]
    assert len(got[0].mixture) == 1 and got[0].score == 1.0
    shares = {m.lang: m.share for m in got[10].mixture}
    assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 2 / 3) < 0.1
    assert all(0 <= r.score <= 1 for r in language.identify(odd, model).collect())
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.Model(train.limit(0))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from paperloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op6_language_mixtures"](spark, sf).join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_words_of_many_texts():
    texts = ["a bc", "", "x", "d-e F", "zz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = W.find(data, at, W.NOT_BLANK)
    assert found.counts().tolist() == [2, 0, 1, 2, 1]
    h = W.span_hashes(np.frombuffer(b"ab ab ba", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert h[0] == h[1] != h[2]


def test_digest_of_ids_in_the_query(spark):
    from paperloom.llm.queries import QUERIES

    row = QUERIES["op8_chunked_bpe"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and row.n_tokens == len(ids)


def test_texts_full_of_personal_data_take_time_by_their_length(spark):
    """1 MB and 2 MB of addresses: every one found and replaced, in at most three times the time (and a second for noise)."""
    def run(size):
        n = size // 26
        docs = spark.createDataFrame([(1, "".join(f"mail bob{i:06d}@example.org " for i in range(n)))], "doc_id long, text string").cache()
        docs.count()
        began = time.perf_counter()
        row = pii.redacted(docs).select(F.regexp_count("text", F.lit("<EMAIL>")).alias("n"), F.length("text").alias("size")).first()
        assert (row.n, row.size) == (n, n * len("mail <EMAIL> "))
        return time.perf_counter() - began

    run(10_000)
    one, two = run(1_000_000), run(2_000_000)
    assert two < 3 * one + 1, (one, two)


def test_a_directory_that_tells_of_bytes_beyond_the_end_is_an_error():
    import zlib

    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = packed.compress(bytes(range(256)) * 99) + packed.flush(zlib.Z_SYNC_FLUSH)  # unfinished
    read_at = lambda at, n: data[at : at + n]
    for pieces in (warc._inflated(read_at, 0, len(data) + 5000), warc._stored_bytes(read_at, 0, len(data) + 5000)):
        with pytest.raises(ValueError, match="ends within"):
            list(pieces)
    record = b"WARC/1.0\r\nContent-Length: 5000000\r\n\r\n" + b"x" * 4_000_000
    with pytest.raises(ValueError, match="ends early"):
        list(warc._records(iter([record[i : i + 65536] for i in range(0, len(record), 65536)])))
