"""Whole-text word and shingle hashing on Arrow batches, in numpy.

A text column arrives as one UTF-8 byte array plus row offsets.  Words are runs
of bytes other than 0x20 and 0x09-0x0D; A-Z fold to a-z.  Since those are all
ASCII, cutting bytes equals cutting characters.  Every word gets a 64-bit hash
from a prefix sum of random byte codes times powers of an odd base, so a batch
needs a fixed number of vector passes and no loop over words.

Nulls count as empty texts.  A row longer than the slice size is a slice of its
own; it is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = (1 << 20) - 2

_rng = np.random.default_rng(20240607)
CODES = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
CODES[65:91] = CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INV = pow(BASE, -1, 2**64)
SHINGLE = np.uint64(0xD1342543DE82EF95)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between calls up to 2**20 entries."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for b in (BASE, BASE_INV):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        if size > 1 << 20:
            return out[0][:n], out[1][:n]
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most limit bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """The words of consecutive rows: start, end, row and hash of each, words per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()):
        n, rows = len(data), len(offsets) - 1
        self.rows = rows
        space = separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        solid = ~space
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.per_row = np.bincount(self.row, minlength=rows).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.per_row)])
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[data] * up[:n], out=total[1:])

        def hashed(end):
            h = (total[end] - total[self.start]) * down[self.start]
            return mix(h ^ ((end - self.start).astype(np.uint64) << np.uint64(40)))

        self.hash = hashed(self.end)
        #: Hashes of the first k bytes of each word of more than k bytes, with the words' positions.
        self.prefix = []
        for k in prefixes:
            long = np.flatnonzero(self.end - self.start > k)
            h = hashed(np.minimum(self.start + k, self.end))[long]
            self.prefix.append((long, mix(h + np.uint64(k))))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every window of width words; a shorter row is one window of all its words."""
        h, row, n = self.hash, self.row, len(self.hash)
        out_rows, out = [], []
        if n >= width:
            s = h[: n - width + 1].copy()
            for k in range(1, width):
                s *= SHINGLE
                s += h[k : n - width + 1 + k]
            whole = row[: n - width + 1] == row[width - 1 :]
            out_rows.append(row[: n - width + 1][whole])
            out.append(mix(s[whole]))
        short = np.flatnonzero((self.per_row > 0) & (self.per_row < width))
        if len(short):
            s = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                on = self.per_row[short] > k
                s[on] = s[on] * SHINGLE + h[self.first[short[on]] + k]
            out_rows.append(short)
            out.append(mix(s ^ self.per_row[short].astype(np.uint64)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(out_rows), np.concatenate(out)


def distinct_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by row, then value; rows may come in any order."""
    order = np.argsort(value)
    row, value = row[order], value[order]
    order = np.argsort(row, kind="stable")
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
