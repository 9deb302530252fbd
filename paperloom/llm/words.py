"""Words of many texts at once: numpy over the one UTF-8 buffer of an Arrow column.

These are the small per-batch helpers of the operators' Arrow functions. Everything is exact on whole texts; a batch is only
cut between rows, so that the arrays of one piece stay a few dozen MB (or as large as one single longer text asks for).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once.
PIECE_BYTES = 1 << 21
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = []


def byte_class(keep) -> np.ndarray:
    """A table of 256 booleans from a predicate on bytes."""
    return np.array([bool(keep(b)) for b in range(256)])


#: `[^\x20\x09-\x0D]+`
NOT_BLANK = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALPHANUMERIC = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: A-Z to a-z, other bytes as they are
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, end row, their UTF-8 bytes, and each text's start in them (and the end of the last). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


@dataclass
class Words:
    """start, end: bytes of each word; first: each text's first word (and the end of the last text's)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def find(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of one kind, none across two texts. kind: a table of booleans, or of numbers where 0 is no kind."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    change = (inside[1:] != inside[:-1]) | edge[1:-1]
    start, end = inside != 0, inside != 0
    start[1:] &= change
    end[:-1] &= change
    start = np.flatnonzero(start)
    return Words(start, np.flatnonzero(end) + 1, np.searchsorted(start, at))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, r, np.uint64))]) for r in (_R, _R_INVERSE)]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial by differences of running sums, then mixed."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start])


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; the last n-1 places are left out."""
    size = len(word) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word[k : k + size]
    return mixed(out)
