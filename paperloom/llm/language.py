"""Language identification as the inference of mixtures.

Every word is taken to be drawn from one of the languages, with the likelihood of its byte n-grams in that language.
Expectation-maximisation estimates a document's proportions of languages from its words; the set of languages is the one of
best penalised likelihood: languages expected to have drawn less than one word go first, then the weakest is left out as long
as the likelihood lost is below PENALTY times the log of the number of words. The prediction is the largest proportion of the
chosen set, the proportion its score. Likelihoods are computed once for each distinct word of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W

#: log2 of the buckets of n-grams for each language.
BUCKET_BITS = 16
SIZES = (1, 2, 3, 4)
#: Most rounds of a fit, and the change of all shares below which it ends; the penalty for a language; smoothing counts.
ROUNDS, MOVED, PENALTY, SMOOTHING, TINY = 12, 1e-3, 2.0, 0.5, np.float32(1e-30)
#: The most languages of a model: its table has 2**BUCKET_BITS numbers for each.
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Letters of words: ASCII letters and all beyond ASCII.
_LETTER = W.byte_class(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)


def _grams(data: np.ndarray, at: np.ndarray):
    """Of the distinct words (a blank before each): buckets of their byte n-grams, and the word of each n-gram. Then all words,
    and which distinct one each is."""
    data = W.LOWER[data]
    found = W.find(data, at, _LETTER)
    _, kept, which = np.unique(W.span_hashes(data, found.start, found.end), return_index=True, return_inverse=True)
    start, size = found.start[kept], (found.end - found.start)[kept]
    first = np.cumsum(size + 1) - (size + 1)
    total = int((size + 1).sum())
    buffer = np.full(total, 0x20, np.uint8)
    inside = np.ones(total, bool)
    inside[first] = False
    buffer[inside] = data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
    word = np.repeat(np.arange(len(size)), size + 1)
    buckets, words = [], []
    for n in SIZES:
        code = np.zeros(max(0, total - n + 1), np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | buffer[k : k + len(code)]
        whole = word[: len(code)] == word[n - 1 :] if len(code) else np.zeros(0, bool)
        code = W.mixed(code[whole] + np.uint64(n << 40))
        buckets.append((code >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        words.append(word[: len(whole)][whole])
    return np.concatenate(buckets), np.concatenate(words), found, which


def _learned(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for row, end, data, at in W.pieces(batch.column(0)):
            buckets, words, found, which = _grams(data, at)
            names = sorted(set(langs[row:end]))
            of_text = np.array([names.index(x) for x in langs[row:end]])
            for k, name in enumerate(names):
                times = np.bincount(which[of_text[found.owner()] == k], minlength=which.max(initial=-1) + 1)
                n = np.bincount(buckets, times[words], minlength=1 << BUCKET_BITS).astype(np.int64)
                counts[name] = counts.get(name, 0) + n
    for name, n in counts.items():
        full = np.flatnonzero(n)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full)), pa.array(full.astype(np.int32)), pa.array(n[full])], ["lang", "bucket", "n"])


class Model:
    """Log-probabilities of n-gram buckets by language; languages in the order of their names."""

    def __init__(self, labelled: DataFrame, text: str = "text", lang: str = "lang"):
        """Counts over all labelled rows; those with a null language are passed over. Languages: as many as labels name."""
        rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("lang"))
        if len(rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()) > MAX_LANGUAGES:
            raise ValueError(f"the labels name more than {MAX_LANGUAGES} languages")
        counts = rows.mapInArrow(_learned, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        self.languages = sorted(counts["lang"].unique())
        table = np.full((len(self.languages), 1 << BUCKET_BITS), SMOOTHING)
        for k, name in enumerate(self.languages):
            own = counts[counts["lang"] == name]
            table[k, own["bucket"]] += own["n"]
        self.log = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32).T.copy() if self.languages else table.T


def _fitted(likelihood: np.ndarray, n_words: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares after expectation-maximisation, and the log-likelihoods. likelihood: words by languages, those of a text together;
    every text has a word. Each text stops by its own change, so its result does not depend on the texts beside it."""
    owner = np.repeat(np.arange(len(n_words)), n_words)
    starts = np.cumsum(n_words) - n_words
    share, moving = share.copy(), np.arange(len(n_words))
    part, size = likelihood, n_words
    for _ in range(ROUNDS):
        joint = part * np.repeat(share[moving], size, axis=0)
        joint /= joint.sum(axis=1, keepdims=True) + TINY
        new = np.add.reduceat(joint, np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)
        more = np.abs(new - share[moving]).max(axis=1) >= MOVED
        share[moving] = new
        if not more.any():
            break
        if not more.all():
            part, moving, size = part[np.repeat(more, size)], moving[more], size[more]
    return share, np.add.reduceat(np.log((likelihood * share[owner]).sum(axis=1) + TINY), starts)


def _mixtures(loglik: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The proportions of every text, zero outside its chosen set. loglik: words by languages, those of a text together."""
    languages = loglik.shape[1]
    out = np.zeros((len(n_words), languages), np.float32)
    texts = np.flatnonzero(n_words)
    if not len(texts):
        return out
    likelihood = np.exp(loglik - loglik.max(axis=1, keepdims=True)).astype(np.float32)
    n = n_words[texts]
    share, _ = _fitted(likelihood, n, np.full((len(texts), languages), 1 / languages, np.float32))
    share[(share * n[:, None] < 1) & (share < share.max(axis=1, keepdims=True))] = 0
    out[texts] = share / share.sum(axis=1, keepdims=True)
    for _ in range(languages - 1):
        several = (out[texts] > 0).sum(axis=1) > 1
        if not several.any():
            break
        likelihood, texts, n = likelihood[np.repeat(several, n)], texts[several], n[several]
        share, fit = _fitted(likelihood, n, out[texts])
        fewer = share.copy()
        in_set = np.where(out[texts] > 0, share, np.inf)
        weakest = languages - 1 - in_set[:, ::-1].argmin(axis=1)  # of equals the last by name
        fewer[np.arange(len(texts)), weakest] = 0
        fewer, fit_fewer = _fitted(likelihood, n, fewer / (fewer.sum(axis=1, keepdims=True) + TINY))
        drop = fit - fit_fewer < PENALTY * np.log(np.maximum(n, 2))
        out[texts] = np.where(drop[:, None], fewer, share)
        likelihood, texts, n = likelihood[np.repeat(drop, n)], texts[drop], n[drop]
        if not len(texts):
            break
    return out


def _predicted(batches, model):
    languages, log = model.value
    for batch in batches:
        for row, end, data, at in W.pieces(batch.column(1), 1 << 20):
            buckets, words, found, which = _grams(data, at)
            texts, n_words = end - row, found.counts()
            distinct = [np.bincount(words, log[buckets, k], minlength=which.max(initial=-1) + 1) for k in range(len(languages))]
            share = _mixtures(np.stack(distinct, axis=1)[which], n_words)
            best = share.argmax(axis=1)
            known = n_words > 0
            lang = pa.array([languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)])
            score = np.where(known, share[np.arange(texts), best], 0.0)
            mixture = pa.array([[{"lang": languages[k], "share": float(s[k])} for k in np.flatnonzero(s)] for s in share], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), lang, pa.array(np.clip(score, 0, 1).astype(np.float64)), mixture], ["id", "lang_pred", "score", "mixture"])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and mixture (language and share of each in the chosen set) per row.

    A null text, one without a letter of any script, or any text if the model knows no language, is `und` with score 0. Equal
    proportions: the language that comes first by name. Very long texts are read whole. Repeated rows stay rows, other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), lettered.alias("t"))
    if not model.languages:
        empty = F.array().cast("array<struct<lang:string,share:double>>")
        return rows.select(F.col("id").alias(doc_id), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), empty.alias("mixture"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log))
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _predicted(it, shared), f"id {kind}, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")
    return out.withColumnRenamed("id", doc_id)
