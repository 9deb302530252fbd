"""Edit-aware token counts.

The state of a document is its text and a segment tree over leaves of about LEAF_BYTES, cut at places where tokens before and
after are certain not to depend on each other (see bpe.certain_boundaries). Each node holds the bytes, code points and tokens
below it, and while edits are applied the leaves hold the text, so an edit neither counts nor copies the rest of it. An edit finds
its leaves by descending the tree, takes in a neighbouring leaf where it has touched the characters that made the
boundary certain, re-encodes that region alone, and updates the sums on the paths to the root. A region that has grown beyond
two leaves is cut into leaves again and the sums are balanced anew, which adds integers but encodes nothing else; so however
many edits meet at one place, each re-encodes a few leaves. Counts stay exact. A stretch without a certain boundary, such as
one very long word, is one leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import bpe
from paperloom.llm import words as W

LEAF_BYTES = 256
_BLANK = " \n"


def _visible(character: str) -> bool:
    return "\x20" < character < "\x7f"


class CountTree:
    """Heap-ordered sums: node k has children 2k and 2k+1, the leaves are the last half. parts: the leaves' bytes."""

    def __init__(self, parts: list[bytes], tokens: list[int]):
        self.reencoded = 0
        self._take(parts, tokens)

    @classmethod
    def stored(cls, text: bytes, size: list[int], count: list[int]) -> CountTree:
        """From a text and the arrays of a state."""
        width, at, parts = len(size) // 2, 0, []
        for n in size[width:]:
            parts.append(text[at : at + n])
            at += n
        return cls(parts, count[width:])

    @classmethod
    def built(cls, text: bytes, sure: np.ndarray, encode) -> CountTree:
        """From a text and its certain boundaries."""
        pieces = _leaves(text, sure, encode)
        return cls([p for p, _ in pieces], [n for _, n in pieces])

    def _take(self, parts: list[bytes], tokens: list[int]) -> None:
        self.leaves = 1
        while self.leaves < len(parts):
            self.leaves *= 2
        pad = self.leaves - len(parts)
        self.parts = [*parts, *[b""] * pad]
        leaves = ([len(p) for p in self.parts], [_points(p) for p in self.parts], [*tokens, *[0] * pad])
        self.size, self.points, self.count = ([0] * self.leaves + values for values in leaves)
        for sums in (self.size, self.points, self.count):
            for k in range(self.leaves - 1, 0, -1):
                sums[k] = sums[2 * k] + sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.count[1]

    @property
    def text(self) -> bytes:
        return b"".join(self.parts)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point (of several at its place a filled one), and the leaf's first code point."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if place >= start + self.points[node] and self.points[node + 1]:
                start += self.points[node]
                node += 1
        return node - self.leaves, start

    def _set(self, leaf: int, part: bytes, tokens: int) -> None:
        node = leaf + self.leaves
        changes = [(sums, now - sums[node]) for sums, now in ((self.size, len(part)), (self.points, _points(part)), (self.count, tokens))]
        self.parts[leaf] = part
        for sums, change in changes:
            at = node
            while at and change:
                sums[at] += change
                at //= 2

    def edit(self, start: int, length: int, new: str, encode) -> None:
        """Replace length code points from start on by new; what lies beyond the text is cut off."""
        start = min(max(start, 0), self.points[1])
        end = min(start + max(length, 0), self.points[1])
        first, low = self.leaf_at(start)
        last, high = self.leaf_at(max(start, end - 1))
        high += self.points[last + self.leaves]
        old = b"".join(self.parts[first : last + 1]).decode()
        region = old[: start - low] + new + old[end - low :]
        while True:
            if low > 0 and (not region or region[0] not in _BLANK):
                before, at = self.leaf_at(low - 1)
                region, first, low = self.parts[before].decode() + region, before, at
            elif high < self.points[1] and (not region or not _visible(region[-1])):
                last, at = self.leaf_at(high)
                region, high = region + self.parts[last].decode(), at + self.points[last + self.leaves]
            else:
                break
        raw = region.encode()
        self.reencoded += len(raw)
        if len(raw) > 2 * LEAF_BYTES:
            pieces = _leaves(raw, bpe.certain_boundaries(np.frombuffer(raw, np.uint8)), encode)
            if len(pieces) > 1:
                return self._replace(first, last, pieces)
        for leaf in range(first + 1, last + 1):
            self._set(leaf, b"", 0)
        return self._set(first, raw, len(encode(region)))

    def _replace(self, first: int, last: int, pieces: list[tuple[bytes, int]]) -> None:
        """New leaves in place of some, empty ones left out, and the sums over all of them."""
        now = list(zip(self.parts, self.count[self.leaves :], strict=True))
        kept = [leaf for leaf in now[:first] + pieces + now[last + 1 :] if leaf[0]]
        self._take([p for p, _ in kept], [n for _, n in kept])


def _points(raw: bytes) -> int:
    return len(raw.decode())


def _leaves(raw: bytes, sure: np.ndarray, encode) -> list[tuple[bytes, int]]:
    at, k, out = 0, 0, []
    while at < len(raw):
        k = int(np.searchsorted(sure, at + LEAF_BYTES))
        end = int(sure[k]) if k < len(sure) else len(raw)
        out.append((raw[at:end], len(encode(raw[at:end].decode()))))
        at = end
    return out


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def _built(batches, path: str):
    encode = bpe.vocabulary(path).encode
    for batch in batches:
        for row, end, data, at in W.pieces(batch.column(1)):
            trees = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                text = data[a:b]
                sure = bpe.certain_boundaries(text) if len(text) else np.zeros(0, np.int64)
                trees.append(CountTree.built(text.tobytes(), sure, encode))
            yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), _lists([t.size for t in trees]), _lists([t.count for t in trees])], ["id", "text", "size", "count"])


def build(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The state of every row: doc_id, text (null: empty), and the trees size and count. An empty text has an empty leaf, a very
    long one a tree as deep as its length's logarithm. Repeated rows stay rows; other columns are ignored, whatever their
    names; an empty table gives no rows."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(lambda it: _built(it, tokenizer), f"id {kind}, text string, size array<int>, count array<int>").withColumnRenamed("id", doc_id)


def _edited(batches, path: str):
    encode = bpe.vocabulary(path).encode
    for batch in batches:
        for low in range(0, len(batch), 256):
            part = batch.slice(low, 256)
            ids, texts, sizes, counts, edits = part.columns
            trees, before = [], []
            for text, size, count, changes in zip(texts.to_pylist(), sizes.to_pylist(), counts.to_pylist(), edits.to_pylist(), strict=True):
                tree = CountTree.stored(text.encode(), size, count)
                before.append(tree.tokens)
                for change in changes or ():
                    if change is not None:
                        tree.edit(change["start"] or 0, change["length"] or 0, change["replacement"] or "", encode)
                trees.append(tree)
            out = [ids, pa.array([t.text.decode() for t in trees]), _lists([t.size for t in trees]), _lists([t.count for t in trees]),
                   pa.array(before, pa.int64()), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.reencoded for t in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["id", "text", "size", "count", "n_tokens_before", "n_tokens", "reencoded_bytes"])


def apply_edits(state: DataFrame, tokenizer: str, edits: str | Column = "edits", doc_id: str = "doc_id") -> DataFrame:
    """The state after each row's edits, with n_tokens_before, n_tokens and reencoded_bytes.

    edits: an array of structs (start, length, replacement) in code points, applied in order, each to the text that the one
    before has left. Places beyond the text are moved to its end, null numbers are 0, a null replacement or array is empty, a
    null edit is none. Repeated rows stay rows and are edited each on its own; an empty table gives no rows.
    """
    rows = state.select(F.col(doc_id).alias("id"), "text", "size", "count", (F.col(edits) if isinstance(edits, str) else edits).alias("edits"))
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _edited(it, tokenizer), f"id {kind}, text string, size array<int>, count array<int>, n_tokens_before bigint, n_tokens bigint, reencoded_bytes bigint")
    return out.withColumnRenamed("id", doc_id)


def sample_edits(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Three edits of a text at places that follow from its id: a replacement, a deletion and a new first line."""
    def place(n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(doc_id), F.lit(n)), F.length(text) + 1).cast("int")

    def edit(start, length: int, new: str) -> Column:
        return F.struct(start.alias("start"), F.lit(length).alias("length"), F.lit(new).alias("replacement"))

    return F.array(edit(place(1), 12, " [corrected] "), edit(place(2), 40, ""), edit(F.lit(0), 0, "Revised.\n"))
