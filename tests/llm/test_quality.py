"""Importance resampling against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import quality
from paperloom.llm import words as W


def bucket(raw: bytes, salt: int | None = None) -> int:
    h = W.span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
    if salt is not None:
        h = W.mixed(h + np.uint64(salt))
    return int(h[0] >> np.uint64(65 - quality.BUCKET_BITS))


def grams(text):
    raw = (text or "").encode()
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    tokens = re.findall(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f0-9a-z\x80-\xff]+", raw)
    out = [bucket(t) for t in tokens]
    out += [bucket(t[:n], n) for t in tokens for n in quality.PREFIXES if len(t) >= n]
    for a, b in zip(tokens, tokens[1:], strict=False):
        two = [W.span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] for t in (a, b)]
        out.append(int(W.gram_hashes(np.array(two), 2)[0] >> np.uint64(65 - quality.BUCKET_BITS)) + (1 << quality.BUCKET_BITS - 1))
    again = int(quality._REPEAT >> np.uint64(65 - quality.BUCKET_BITS))
    return out + [again for a, b in zip(tokens, tokens[1:], strict=False) if a == b]


def log_weights(docs, target_ids):
    raw, target = Counter(), Counter()
    for doc, text in docs:
        found = grams(text)
        raw.update(found)
        if doc in target_ids:
            target.update(found)
    scale = target.total() / raw.total()
    lam = {b: math.log((target[b] + quality.SMOOTHING) / (raw[b] * scale + quality.SMOOTHING)) for b in raw}
    return [sum(lam[b] for b in grams(text)) if grams(text) else None for _, text in docs]


@pytest.mark.parametrize("k", [None, 3])
def test_weights_keys_and_kept_rows(spark, odd, odd_rows, k):
    labels = spark.createDataFrame([(n, int(n not in (11, 12)), int(n == 14), 5) for n in range(1, 15)], "doc_id long, quality int, toxic int, weight int")
    sample = {r.doc: r for r in quality.labelled_sample(labels, "doc_id", "quality", "toxic").collect()}
    good = {d for d, r in sample.items() if r.good and not r.held_out}
    assert good and any(r.held_out for r in sample.values())
    want = log_weights([r[:2] for r in odd_rows], good)
    noise = {r.doc_id: r.g for r in odd.select("doc_id", quality.gumbel(F.col("doc_id"), 0).alias("g")).collect()}
    chosen = quality.select(odd, labels, k=k)
    rows = chosen.scores().collect()
    expect = [(r[0], w, None if w is None else w + noise[r[0]]) for r, w in zip(odd_rows, want, strict=True)]
    order = lambda x: (repr(x[0]), -math.inf if x[1] is None else x[1])
    for got, (doc, w, key) in zip(sorted(((r.doc_id, r.log_weight, r.key) for r in rows), key=order), sorted(expect, key=order), strict=True):
        assert got[0] == doc and (got[1] is None) == (w is None)
        assert w is None or (math.isclose(got[1], w, abs_tol=1e-6) and math.isclose(got[2], key, abs_tol=1e-6))
    keys = sorted((key for *_, key in expect if key is not None), reverse=True)
    size = sum(w is not None and w >= chosen.threshold for w in want) if k is None else min(k, len(keys))
    cut = keys[size - 1] if size else math.inf
    assert chosen.k == size
    assert Counter(r.doc_id for r in rows if r.kept) == Counter(doc for doc, _, key in expect if key is not None and key >= cut - 1e-9)
    assert chosen.kept(odd).count() == sum(r.kept for r in rows) and chosen.kept(odd).columns == odd.columns
    assert any(w > 0 for w in want if w is not None) and any(w < 0 for w in want if w is not None)


def test_draws_follow_the_weights(spark):
    """Of two documents with equal weight either is drawn about as often, over many seeds; a much better one nearly always."""
    rows = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 6.0)], "doc long, weight double")
    first = Counter()
    drawn = rows.select("doc", *((F.col("weight") + quality.gumbel(F.col("doc"), seed)).alias(f"s{seed}") for seed in range(60))).collect()
    for seed in range(60):
        key = {r.doc: r[f"s{seed}"] for r in drawn}
        first[1 if key[1] > key[2] else 2] += 1
        first["best"] += key[3] > max(key[1], key[2])
    assert 15 <= first[1] <= 45 and first["best"] >= 55


def test_threshold_reads_a_row_for_each_id(spark, monkeypatch):
    docs = spark.createDataFrame([(n % 40, f"word{n % 40} the river {'bad' if n % 2 else 'good'}") for n in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, 1 - n % 2, 0) for n in range(40)], "doc_id long, quality int, toxic int")
    seen, real = [], quality._threshold
    monkeypatch.setattr(quality, "_threshold", lambda rows: seen.append((rows.count(), rows.select("doc").distinct().count())) or real(rows))
    quality.select(docs, labels)
    assert seen[0][0] == seen[0][1] > 0
