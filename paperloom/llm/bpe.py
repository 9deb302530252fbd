"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over the last 32 bytes cuts texts where it has CHUNK_BITS zero bits, so equal stretches of different texts are
cut alike. Chunks that occur twice or more in the corpus are encoded once, on their own, in a job over distinct chunks; a text
is then put together from such chunks and from its own encoding of what is left.

Where a chunk meets other text its tokens may differ from those of the whole text, so every join is repaired: a window from the
last sure place before the chunk is encoded again, and widened into the chunk, until it agrees with the chunk. Two encodings
agree at a place where both have a boundary between the pre-tokenizer's matches and the tokens that both have behind it are
equal. The pattern looks at nothing behind it, so from such a place on both encodings are the same until the chunk's end, of
which the last bytes are left to the next window. A chunk that agrees nowhere is encoded with the text. The result is exact.

Texts without a shared chunk are encoded where they are read. A bitmap of the shared chunks' hashes tells them apart (a false
hit sends a text the other way, with the same result); only texts that share something, and their chunks, are shuffled.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.bitmaps import bitmap, contains
from paperloom.llm.tables import stored

#: log2 of the mean bytes between cuts, and the fewest bytes of a chunk that is worth looking up.
CHUNK_BITS, MIN_CHUNK = 9, 64
#: Bytes of a chunk that the first window at a join takes in.
REACH = 64
#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GEAR = W.mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)).astype(np.uint32)
_ROLLING = 32


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable, else the next unused character from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


def _refused(spec: dict) -> str | None:
    """Why a tokenizer file is none that this module encodes exactly; None if it is one."""
    pre, model, decoder = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("decoder") or {}
    if spec.get("normalizer") is not None:
        return "it has a normalizer"
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return "its pre-tokenizer is not byte-level BPE's pattern without a prefix space"
    if decoder.get("type") != "ByteLevel":
        return "its decoder is not byte-level"
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return "its model is not plain BPE"
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return "its added tokens are not matched literally"
    if any(re.search(r"\s", t.get("content", "")) for t in spec.get("added_tokens", [])):
        return "an added token holds a blank, where texts are cut"
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
    if None in merged or any(b <= a for a, b in zip(merged, merged[1:], strict=False)):
        return "its merges do not follow the order of their tokens' ids"
    return None


class Vocabulary:
    """Encoder and decoder of a byte-level BPE file in the tokenizers library's format, special tokens included. Other files
    (see _refused) are refused with a ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if why := _refused(spec):
            raise ValueError(f"{path} can't be used: {why}")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = _byte_symbols()
        ranks = {bytes(symbols[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for token, n in [*ranks.items(), *((t.encode(), n) for t, n in added.items())]:
            self.bytes_of[n] = token
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.added = set(added)
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern = regex.compile(PATTERN)
        #: Boundaries at least so far from an end do not depend on what follows: a contraction or a blank's next character
        #: reach six bytes, an added token its own length.
        self.margin = 8 + max((len(t.encode()) for t in added), default=0)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all", disallowed_special=())

    def encoded(self, raw: bytes) -> np.ndarray:
        return np.array(self.encode(raw.decode()), np.int32)

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def boundaries(self, raw: bytes) -> list[int]:
        """Where the pre-tokenizer's matches end, in bytes."""
        at, out = 0, []
        for part in self.splitter.split(raw.decode()) if self.splitter else [raw.decode()]:
            for piece in [part] if part in self.added else self.pattern.findall(part):
                at += len(piece.encode())
                out.append(at)
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def certain_boundaries(data: np.ndarray) -> np.ndarray:
    """Places p where tokens before and from p on never depend on each other: the pattern never matches across a space or line
    feed behind a visible ASCII character, it looks at nothing before it, and no special token holds one."""
    visible = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    blank = (data[1:] == 0x20) | (data[1:] == 0x0A)
    return np.flatnonzero(visible & blank) + 1


def cuts(data: np.ndarray) -> np.ndarray:
    """Content-defined cuts: places whose last 32 bytes' rolling hash has CHUNK_BITS zero bits, at starts of characters."""
    h = _GEAR[data]
    for k in range(5):  # sums of 2, 4, ... 32 bytes, each shifted by its distance
        step = 1 << k
        far = h.copy()
        far[step:] += h[:-step] << np.uint32(step)
        h = far
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    at = at[at < len(data)]
    return at[data[at] & 0xC0 != 0x80]


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of MIN_CHUNK bytes or more of the texts in one buffer: text, start, end, hash. No cut depends on another text."""
    cut = cuts(data)
    cut = cut[cut - at[np.searchsorted(at, cut, "right") - 1] >= _ROLLING]
    edges = np.union1d(cut, at)
    start, end = edges[:-1], edges[1:]
    long = end - start >= MIN_CHUNK
    start, end = start[long], end[long]
    return np.searchsorted(at, start, "right") - 1, start, end, W.span_hashes(data, start, end).view(np.int64)


# The shared chunks -----------------------------------------------------------------------------------------------------


def _hashes(batches):
    for batch in batches:
        for _, _, data, at in W.pieces(batch.column(0)):
            found, n = np.unique(chunks(data, at)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["hash", "n"])


def _sharing(batches, shared):
    """Texts with a chunk that is shared: id, text, key of the text, hashes of such chunks, each once."""
    for batch in batches:
        for row, end, data, at in W.pieces(batch.column(1)):
            text, _, _, hashes = chunks(data, at)
            known = contains(shared.value, hashes)
            pairs = np.unique(np.stack([text[known], hashes[known]], axis=1), axis=0)
            n = np.bincount(pairs[:, 0], minlength=end - row)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(pairs[:, 1]))
            out = pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), lists], ["id", "t", "hashes"])
            yield out.filter(pa.array(n > 0))


def _chunk_texts(batches):
    """The shared chunks of texts, each once a task's batch: hash, chunk."""
    for batch in batches:
        wanted = np.unique(batch.column(1).flatten().to_numpy(zero_copy_only=False))
        seen: set[int] = set()
        for _, _, data, at in W.pieces(batch.column(0)):
            _, start, end, hashes = chunks(data, at)
            hashes, first = np.unique(hashes, return_index=True)
            kept = np.isin(hashes, wanted) & np.array([h not in seen for h in hashes.tolist()], bool)
            seen.update(hashes[kept].tolist())
            texts = [data[a:b].tobytes() for a, b in zip(start[first[kept]].tolist(), end[first[kept]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[kept]), pa.array(texts, pa.binary())], ["hash", "chunk"])


def _encoded_chunks(batches, path: str):
    """hash, token ids of the chunk alone, and its last boundary that does not depend on what follows: byte and token."""
    own = vocabulary(path)
    for batch in batches:
        ids, bytes_, tokens = [], [], []
        for raw in batch.column(1).to_pylist():
            got = own.encoded(raw)
            sure = [p for p in own.boundaries(raw) if p <= len(raw) - own.margin]
            at = np.cumsum(own.sizes[got])
            last = sure[-1] if sure else 0
            ids.append(got)
            bytes_.append(last)
            tokens.append(int(np.searchsorted(at, last, "right")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(bytes_, pa.int32()), pa.array(tokens, pa.int32())], ["hash", "ids", "sure_bytes", "sure_tokens"])


# Putting texts together ------------------------------------------------------------------------------------------------


class _Text:
    """The encoding of one text, built from the left: ids so far, and the byte up to which they are those of the whole text."""

    def __init__(self, own: Vocabulary, raw: bytes):
        self.own, self.raw, self.ids, self.upto, self.reused = own, raw, [], 0, 0

    def _character(self, p: int) -> int:
        while p < len(self.raw) and self.raw[p] & 0xC0 == 0x80:
            p += 1
        return p

    def encode_to(self, end: int) -> None:
        """Encode on to the last certain boundary before end, which leaves a short window."""
        part = np.frombuffer(self.raw, np.uint8, end - self.upto, self.upto)
        sure = certain_boundaries(part) if len(part) else part
        if len(sure):
            last = int(sure[-1])
            self.ids.append(self.own.encoded(self.raw[self.upto : self.upto + last]))
            self.upto += last

    def join(self, start: int, end: int, ids: np.ndarray, sure_bytes: int, sure_tokens: int) -> None:
        """Go on with the tokens of the chunk at start, once an encoding from the left agrees with them."""
        own, ends = self.own, np.cumsum(self.own.sizes[ids])
        if self.upto >= start + sure_bytes:
            return
        if self.upto < start:
            self.encode_to(start)
        reach = max(start, self.upto) + REACH
        while True:
            reach = min(self._character(reach), end)
            limit = reach - own.margin
            window = self.raw[self.upto : reach]
            alone = {start} | {start + p for p in own.boundaries(self.raw[start:reach])}
            common = [p for q in [0, *own.boundaries(window)] if start <= (p := self.upto + q) <= min(limit, start + sure_bytes) and p in alone]
            if common:
                got = own.encoded(window)
                got_ends = self.upto + np.cumsum(own.sizes[got])
                for place in common:
                    a, b = (int(np.searchsorted(e, p, "right")) for e, p in ((got_ends, place), (ends, place - start)))
                    n = int(np.searchsorted(got_ends, limit, "right")) - a  # tokens that end before the window's doubtful bytes
                    if n > 0 and np.array_equal(got[a : a + n], ids[b : b + n]):
                        self.ids += [got[:a], ids[b:sure_tokens]]
                        self.reused += start + sure_bytes - place
                        self.upto = start + sure_bytes
                        return
            if reach == end:
                return
            reach = max(start, self.upto) + 2 * (reach - max(start, self.upto))

    def finish(self) -> np.ndarray:
        self.ids.append(self.own.encoded(self.raw[self.upto :]))
        return np.concatenate(self.ids)


def assembled(own: Vocabulary, raw: bytes, places: list[tuple[int, int, int]], known: dict) -> tuple[np.ndarray, int]:
    """The token ids of a text, and how many of its bytes were not encoded anew. places: start, end and hash of its chunks;
    known: (ids, sure_bytes, sure_tokens) by hash. A chunk whose ids spell other bytes (its hash is another's) is not used."""
    text = _Text(own, raw)
    for start, end, h in places:
        if (found := known.get(h)) is not None and found[1] and b"".join([own.bytes_of[i] for i in found[0]]) == raw[start:end]:
            text.join(start, end, *found)
    return text.finish(), text.reused


def _emitted(ids: pa.Array, found: list[tuple[np.ndarray, int]], own: Vocabulary) -> pa.RecordBatch:
    flat = np.concatenate([f[0] for f in found])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)), pa.array(flat.astype(np.int32)))
    decoded = [own.decode(f[0].tolist()) for f in found]
    return pa.RecordBatch.from_arrays([ids, lists, pa.array(decoded, pa.string()), pa.array([f[1] for f in found], pa.int64())], ["id", "ids", "decoded", "reused_bytes"])


def _assembled(batches, path: str):
    own = vocabulary(path)
    for batch in batches:
        for row, end, data, at in W.pieces(batch.column(1), 1 << 20):
            text, start, stop, hashes = chunks(data, at)
            first = np.searchsorted(text, np.arange(end - row + 1))
            found = []
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                known = {c["hash"]: (np.array(c["ids"], np.int32), c["sure_bytes"], c["sure_tokens"]) for c in batch.column(2)[row + k].as_py() or ()}
                own_chunks = slice(first[k], first[k + 1])
                places = list(zip((start[own_chunks] - a).tolist(), (stop[own_chunks] - a).tolist(), hashes[own_chunks].tolist(), strict=True))
                found.append(assembled(own, data[a:b].tobytes(), places, known))
            yield _emitted(batch.column(0).slice(row, end - row), found, own)


def _alone(batches, path: str, shared):
    """The encoding of texts that share no chunk."""
    own = vocabulary(path)
    for batch in batches:
        for row, end, data, at in W.pieces(batch.column(1), 1 << 20):
            text, _, _, hashes = chunks(data, at)
            free = np.ones(end - row, bool)
            free[text[contains(shared.value, hashes)]] = False
            if free.any():
                found = [(own.encoded(data[a:b].tobytes()), 0) for a, b, f in zip(at[:-1].tolist(), at[1:].tolist(), free.tolist(), strict=True) if f]
                yield _emitted(batch.column(0).slice(row, end - row).filter(pa.array(free)), found, own)


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded, reused_bytes) per row: the token ids of the whole text, the text decoded from them, and the bytes
    whose tokens came from shared chunks.

    Special tokens in a text are encoded as such. Null and empty texts have no ids and decode to the empty text; very long ones
    are encoded whole. Repeated rows stay rows; other columns are ignored, whatever their names; an empty table gives no rows.
    tokenizer: path of the vocabulary file, readable by every executor; a file of another kind is refused.
    """
    spark = docs.sparkSession
    vocabulary(tokenizer)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema[0].dataType.simpleString()
    counts = rows.select("t").mapInArrow(_hashes, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    hashes = stored(counts.filter("n > 1").select("hash"), "shared-hashes")
    shared = spark.sparkContext.broadcast(bitmap(hashes))

    result = f"id {kind}, ids array<int>, decoded string, reused_bytes bigint"
    alone = rows.mapInArrow(lambda it: _alone(it, tokenizer, shared), result)
    sharing = stored(rows.mapInArrow(lambda it: _sharing(it, shared), f"id {kind}, t string, hashes array<bigint>").withColumn("key", F.xxhash64("t")), "sharing")
    texts = sharing.select("t", "hashes").mapInArrow(_chunk_texts, "hash bigint, chunk binary").dropDuplicates(["hash"])
    encoded = stored(texts.mapInArrow(lambda it: _encoded_chunks(it, tokenizer), "hash bigint, ids array<int>, sure_bytes int, sure_tokens int"), "encoded-chunks")
    # Plain joins of stored tables: a chunk or a text that very many rows hold is a skewed partition, which adaptive execution splits.
    uses = sharing.select("key", F.explode("hashes").alias("hash")).distinct().join(encoded, "hash")
    lists = uses.groupBy("key").agg(F.collect_list(F.struct("hash", "ids", "sure_bytes", "sure_tokens")).alias("known"))
    together = sharing.select("id", "t", "key").join(stored(lists, "chunks-of-texts"), "key").select("id", "t", "known")
    return alone.unionByName(together.mapInArrow(lambda it: _assembled(it, tokenizer), result)).withColumnRenamed("id", doc_id)
