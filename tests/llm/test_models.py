"""Language mixtures and bootstrapped identifiers against plain Python, and the pipeline's stages on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import language, pii

MASK = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & MASK
    return x ^ x >> 31


def log_likelihoods(word, model):
    raw, out = b" " + word, [0.0] * len(model.languages)
    for n in language.SIZES:
        for i in range(len(raw) - n + 1):
            bucket = mixed((int.from_bytes(raw[i : i + n], "big") + (n << 40)) & MASK) >> 64 - language.BUCKET_BITS
            out = [a + float(b) for a, b in zip(out, model.log[bucket], strict=True)]
    return out


def fitted(likelihood, share):
    for _ in range(language.ROUNDS):
        new = [0.0] * len(share)
        for row in likelihood:
            joint = [p * s for p, s in zip(row, share, strict=True)]
            new = [a + j / (sum(joint) + 1e-30) / len(likelihood) for a, j in zip(new, joint, strict=True)]
        moved, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
        if moved < language.MOVED:
            break
    return share, sum(math.log(sum(p * s for p, s in zip(row, share, strict=True)) + 1e-30) for row in likelihood)


def mixture(text, model):
    """The languages and shares of a text, one word and one step at a time."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[a-z\x80-\xff]+", raw)
    if not words or not regex.search(r"\p{L}", text):
        return {}
    rows = [log_likelihoods(w, model) for w in words]
    likelihood = [[math.exp(x - max(r)) for x in r] for r in rows]
    k = len(model.languages)
    share, _ = fitted(likelihood, [1 / k] * k)
    share = [0 if s * len(words) < 1 and s < max(share) else s for s in share]
    share = [s / sum(share) for s in share]
    while sum(s > 0 for s in share) > 1:
        inside = [n for n, s in enumerate(share) if s > 0]
        share, fit = fitted(likelihood, share)
        weakest = min(inside, key=lambda n: (share[n], -n))
        fewer = [0 if n == weakest else s for n, s in enumerate(share)]
        fewer, fit_fewer = fitted(likelihood, [s / sum(fewer) for s in fewer])
        if fit - fit_fewer >= language.PENALTY * math.log(max(len(words), 2)):
            break
        share = fewer
    return {model.languages[n]: s for n, s in enumerate(share) if s > 0}


def test_mixtures_equal_plain_em(spark):
    rng = random.Random(3)
    pools = {"aa": "banana papaya guava lalala mamama".split(), "bb": "strich pflicht schwer kurz wurst".split(), "cc": "yeon quoi oiseau beaux eux".split()}

    def text(lang, n):
        return " ".join(rng.choice(pools[lang]) + rng.choice(pools[lang]) for _ in range(n))

    model = language.Model(spark.createDataFrame([(text(lang, 30), lang) for lang in pools for _ in range(20)], "text string, lang string"))
    docs = [(n, " ".join(text(lang, rng.randrange(0, 25)) for lang in rng.sample(sorted(pools), rng.randrange(1, 4))) + rng.choice(["", " 12", " É zzz Wurstbanana"])) for n in range(40)] + [(50, None), (51, "1 2"), (52, "x")]
    got = {r.doc_id: {m.lang: m.share for m in r.mixture} for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for n, t in docs:
        want = mixture(t, model)
        assert set(got[n]) == set(want) and all(abs(got[n][k] - want[k]) < 2e-3 for k in want), (t, got[n], want)
    alone = {r.doc_id: {m.lang: m.share for m in r.mixture} for r in language.identify(spark.createDataFrame(docs[:1], "doc_id long, text string"), model).collect()}
    assert alone[0] == got[0]


def bootstrapped(texts):
    """Added spans of each text, with every mention, pattern and value in dictionaries."""
    spans_of, mentions = [pii_base(t) for t in texts], []
    for n, t in enumerate(texts):
        found = list(regex.finditer(pii.MENTION.replace("\\x20", " "), t))
        for k, m in enumerate(found):
            value = m.group()
            if "@" not in value and len(re.sub("[^0-9]", "", value)) < pii.MIN_DIGITS and not re.search(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", value):
                continue
            before = regex.findall(r"\p{L}+", t[found[k - 1].end() if k else 0 : m.start()].lower())
            after = regex.findall(r"\p{L}+", t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)].lower())
            shape = regex.sub(r"\p{L}+", "a", re.sub("[0-9]+", "9", value))
            patterns = {f"< {before[-1]} {shape}"} if before else set()
            patterns |= ({f"<< {before[-2]} {before[-1]} {shape}"} if len(before) > 1 else set()) | ({f"> {after[0]} {shape}"} if after else set())
            rank = next((r for a, r, b in spans_of[n] if a < m.end() and b > m.start()), None)
            mentions.append((n, m.start(), m.end(), value, rank, patterns))
    known = {(v, r): 1.0 for *_, v, r, _ in mentions if r is not None}
    seeds = {v for v, _ in known}
    values_of, patterns_of = defaultdict(set), defaultdict(set)
    for *_, v, _, patterns in mentions:
        for p in patterns:
            values_of[p].add(v)
            patterns_of[v].add(p)
    done = set(seeds)
    while True:
        trust = {}
        for p, values in values_of.items():
            for r in range(4):
                scores = [known[v, r] for v in values if (v, r) in known]
                if len(scores) >= pii.MIN_SEEDS and sum(scores) / (len(values) + 1) >= pii.MIN_PATTERN:
                    trust[p, r] = sum(scores) / (len(values) + 1)
        new = {}
        for v, patterns in patterns_of.items():
            sure = [(1 - math.prod(max(1 - trust[p, r], 1e-6) for p in patterns if (p, r) in trust), -r) for r in range(4) if any((p, r) in trust for p in patterns)]
            if v not in done and sure and max(sure)[0] >= pii.MIN_VALUE:
                new[v, -max(sure)[1]] = max(sure)[0]
        if not new:
            break
        known |= new
        done |= {v for v, _ in new}
    rank_of = {v: r for (v, r) in known if v not in seeds}
    return [{(a, rank_of[v], b) for m, a, b, v, r, _ in mentions if m == n and r is None and v in rank_of} for n in range(len(texts))]


def pii_base(text):
    from test_corpus_operators import base_spans

    return base_spans(text)


def test_bootstrapping_equals_plain_python(spark):
    """Templates around valid and invalid numbers and addresses, far words, chains of contexts, texts without words."""
    rng = random.Random(8)
    valid, broken = ["4111111111111111", "5500005555555559", "340000000000009"], [f"4{rng.randrange(10**14):014d}{n}" for n in range(10)]
    hosts = [f"10.0.0.{n}" for n in range(9)] + [f"999.1.{n}.3" for n in range(6)]
    templates = ["please charge card {} today", "paid with card number {} at noon", "number {} was printed", "from host {} came a request", "the address {} answered", "serial {}", "{}", "far" + "." * 200 + " {} near"]
    texts = [rng.choice(templates).format(rng.choice(valid if k % 3 else broken) if rng.random() < 0.6 else rng.choice(hosts)) + rng.choice(["", " and charge card " + rng.choice(broken), " mail a@b.co or c@d"]) for k in range(250)]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = bootstrapped(texts)
    added = [{(s.start, s.rank, s.end) for s in got[n].spans} - {(s.start, s.rank, s.end) for s in got[n].base} for n in range(len(texts))]
    assert added == want and sum(map(len, want)) > 20


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_no_rows(spark, odd, empty, name):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns; each stage alone, and on an empty table."""
    stage, sf = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    out = stage(spark, odd, sf)
    rows = out.collect()
    assert stage(spark, empty, sf).count() == 0
    if name == "tokens":
        assert len(rows) == odd.count()
        return
    assert out.columns == odd.columns
    if name == "personal_data":
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.select("doc_id").collect())
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert Counter(rows) <= Counter(odd.collect()) or name == "personal_data"
    assert out.filter(F.col("gone_id") != 1).count() == 0
