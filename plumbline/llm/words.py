"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; the bytes of
one UTF-8 character never fall in that set, so words are the same as on
characters.  Everything is computed on whole byte buffers: no Python object is
made for a word.  Word hashes are 64-bit polynomials over a random byte table,
finished by a mixing function, and depend on nothing but the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT)


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """An independent hash of 64-bit values for each salt."""
    return mix(x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = n + (n >> 2)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


@dataclass
class Words:
    """Words of a block of texts; ``doc`` is the row of each word."""

    rows: int
    data: np.ndarray       # the bytes, lower-cased if asked
    offsets: np.ndarray    # rows + 1 byte offsets
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray      # rows + 1 word offsets

    def hashes(self) -> np.ndarray:
        n = len(self.data) + 1
        power, inverse = _power_tables(n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLE[self.data] * power[:n - 1], out=sums[1:])
        poly = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(poly + (self.end - self.start).astype(np.uint64) * _MULT)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = (np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None
           else np.zeros(0, np.uint8))
    return raw, off - off[0]


def split_words(column: pa.Array, lower: bool = False) -> Words:
    if len(column) == 0:
        zero = np.zeros(0, np.int64)
        return Words(0, np.zeros(0, np.uint8), np.zeros(1, np.int64), zero, zero, zero,
                     np.zeros(1, np.int64))
    raw, off = texts_of(column)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    n = len(raw)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = off[(off > 0) & (off < n)]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(len(off) - 1, raw, off, start, end, doc, first)


def slices(batch: pa.RecordBatch, text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with at most ``limit`` text bytes, or one longer row."""
    if batch.num_rows == 0:
        return
    _, off = texts_of(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def window_hashes(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of every ``size`` consecutive values (across rows too)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * np.uint64(_ODD) + salted(h[k:k + n], salt)
        return mix(out)
    m = len(h) + 1
    power, inverse = _power_tables(m)
    sums = np.zeros(m, np.uint64)
    np.cumsum(salted(h, salt) * power[:m - 1], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[:n])


def starts_of_windows(w: Words, size: int) -> np.ndarray:
    """Word indexes where ``size`` consecutive words of one row start."""
    at = np.arange(max(0, len(w.start) - size + 1))
    return at[w.doc[at] == w.doc[at + size - 1]] if len(at) else at


def lists_by_row(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """A list column from values that are ordered by row."""
    off = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
