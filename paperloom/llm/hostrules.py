"""Quality rules at the level of hosts.

Each document fails or passes a few rules on its whole text. Failures are summed by host; each rule's failure rates over all
hosts give an empirical beta prior (by moments), and a host's rate is shrunk towards it, so that a host with few documents is
not condemned by one of them. A host whose shrunk rate of any rule exceeds MAX_RATE is rejected with all its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.tables import stored

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT = 20, 30, 10
#: A host is rejected above this shrunk failure rate; the prior weighs at least and at most so many documents.
MAX_RATE, PRIOR_DOCUMENTS = 0.5, (1.0, 1e6)
#: The most hosts whose verdicts are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
RULES = ("short", "repeats", "symbols")
_SYMBOL = W.byte_class(lambda b: chr(b) in "#*$%&|<>")
_STARTS_CHARACTER = W.byte_class(lambda b: b & 0xC0 != 0x80)


def _by_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[at[1:]] - sums[at[:-1]]


def _later_equals(key: np.ndarray) -> np.ndarray:
    """Places whose key stands at an earlier place too."""
    order = np.argsort(key, kind="stable")
    return order[1:][key[order[1:]] == key[order[:-1]]]


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the texts in one buffer."""
    texts = len(at) - 1
    inside = W.NOT_BLANK[data]
    found = W.find(data, at, W.NOT_BLANK)
    owner = found.owner()

    newline = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([at[:-1], newline + 1]))
    line_of = np.concatenate([np.arange(texts), np.searchsorted(at, newline, "right") - 1])
    line_of = np.sort(line_of)
    line_end = np.empty_like(line_start)
    line_end[:-1] = np.where(line_of[1:] == line_of[:-1], line_start[1:] - 1, at[1:][line_of[:-1]])
    line_end[-1:] = at[-1]
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[line_end] > filled[line_start]
    line_of = line_of[worded]
    text_salt = W.mixed(np.arange(1, texts + 1, dtype=np.uint64))
    again = _later_equals(W.span_hashes(data, line_start[worded], line_end[worded]) ^ text_salt[line_of])

    gram = W.gram_hashes(W.span_hashes(data, found.start, found.end), WINDOW)
    whole = np.flatnonzero(owner[: len(gram)] == owner[WINDOW - 1 :]) if len(gram) else np.zeros(0, np.int64)
    key = gram[whole] ^ text_salt[owner[whole]]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = whole[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(order) else whole
    cover = np.zeros(len(owner) + WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return {
        "n_words": found.counts(), "word_chars": _by_text(inside & _STARTS_CHARACTER[data], at), "n_symbols": _by_text(_SYMBOL[data], at),
        "n_dup_lines": np.bincount(line_of[again], minlength=texts),
        "n_repeat_words": np.bincount(owner[np.cumsum(cover)[: len(owner)] > 0], minlength=texts)}


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches):
    for batch in batches:
        for row, end, data, at in W.pieces(batch.column(1)):
            got = measures(data, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *(pa.array(got[n].astype(np.int64)) for n in _NAMES)], ["id", *_NAMES])


def _rules() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS, "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")}


def hosts(rows: DataFrame) -> DataFrame:
    """Per host (column host, not null): documents n, failures of each rule, its shrunk rates, and the verdict accepted."""
    counts = stored(rows.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(rule).alias(name) for name, rule in _rules().items())), "hosts")
    sums = counts.agg(F.sum("n").alias("n"), *(F.sum(r).alias(r) for r in RULES), *(F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_2") for r in RULES)).first()
    out, accepted = counts, F.lit(True)
    for rule in RULES if sums["n"] else ():
        mean = sums[rule] / sums["n"]
        variance = sums[f"{rule}_2"] / sums["n"] - mean * mean
        low, high = PRIOR_DOCUMENTS
        weight = min(high, max(low, mean * (1 - mean) / variance - 1)) if variance > 1e-12 else high
        rate = (F.col(rule) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        out = out.withColumn(f"{rule}_rate", rate)
        accepted = accepted & (rate <= MAX_RATE)
    return out.withColumn("accepted", accepted)


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: doc_id, the measures, base_failed, host, host_accepted and kept.

    Null and empty texts have no words and fail. A row without a host is judged on its own. Repeated rows each count for
    their host. Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.struct(F.col(doc_id).alias("doc"), F.col(host).alias("host")).alias("id"), F.col(text).alias("t"))
    kind = base.schema[0].dataType.simpleString()
    measured = base.mapInArrow(_measured, f"id {kind}, " + ", ".join(f"{n} bigint" for n in _NAMES))
    rows = stored(measured.select("id.doc", "id.host", *_NAMES), "measures")
    verdicts = stored(hosts(rows).select("host", "accepted"), "verdicts")
    joined = rows.join(F.broadcast(verdicts) if verdicts.count() <= MAX_BROADCAST else verdicts, "host", "left")
    failed = _rules()["short"] | _rules()["repeats"]
    accepted = F.coalesce("accepted", F.lit(True))
    return joined.select(F.col("doc").alias(doc_id), *_NAMES, failed.alias("base_failed"), "host", accepted.alias("host_accepted"), (~failed & accepted).alias("kept"))


_RATE = "(r.{0} + p.{0}_m * p.{0}_w) / (r.n + p.{0}_w) <= 0.5"
_PRIOR = "sum({0}) / sum(n) AS {0}_m, sum({0} * {0} / n) / sum(n) - (sum({0}) / sum(n)) * (sum({0}) / sum(n)) AS {0}_v"
_WEIGHT = "{0}_m, CASE WHEN {0}_v > 1e-12 THEN least(1e6, greatest(1.0, {0}_m * (1 - {0}_m) / {0}_v - 1)) ELSE 1e6 END AS {0}_w"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
l AS (SELECT r, line, count(*) - 1 AS again FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line),
g AS (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q
  FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY r),
m AS (SELECT d.doc_id, d.source, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(x.again, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN (SELECT r, sum(again) AS again FROM l GROUP BY r) x USING (r) LEFT JOIN c USING (r)),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (n_words < 20)::DOUBLE AS short,
  count(*) FILTER (100 * n_repeat_words > 30 * n_words)::DOUBLE AS repeats, count(*) FILTER (100 * n_symbols > 10 * word_chars)::DOUBLE AS symbols
  FROM m WHERE source IS NOT NULL GROUP BY source),
v AS (SELECT {", ".join(_PRIOR.format(r) for r in RULES)} FROM h),
p AS (SELECT {", ".join(_WEIGHT.format(r) for r in RULES)} FROM v),
k AS (SELECT r.source, {" AND ".join(_RATE.format(r) for r in RULES)} AS accepted FROM h r, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(accepted, true) AS kept
FROM m LEFT JOIN k ON m.source = k.source
"""
