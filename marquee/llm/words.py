"""Words of Arrow text columns as 64-bit hashes, computed on the column's bytes without Python strings.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. In UTF-8 those bytes occur in
no other character, so byte runs and character runs are the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Bytes of words: all but white space, or letters and digits (with all letters beyond ASCII).
WORD = ~SPACE
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
# Words of more bytes are hashed one by one.
_LONG = 256
# The first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take about ``most`` bytes together; a longer text is a range of its own."""
    _, offsets = text_bytes(column)
    start, rows = 0, len(column)
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, rows)
        start = stop


class Words:
    """Word hashes of some rows: ``hashes[first[i]:first[i + 1]]`` are the words of row i."""

    def __init__(self, column: pa.Array, lower: bool = False, inner: np.ndarray = WORD):
        self.data, self.offsets = text_bytes(column)
        data = self.data
        if lower:
            data = lowered(data)
        self._read = data
        inside = inner[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        # A row's first and last byte bound its words.
        filled = self.offsets[:-1] < self.offsets[1:]
        heads, tails = self.offsets[:-1][filled], self.offsets[1:][filled] - 1
        begins[heads] = inside[heads]
        ends[tails] = inside[tails]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.hashed(0)

    def hashed(self, key: int) -> np.ndarray:
        """The words' hashes under another key."""
        return hashed(self._read, self.starts, self.stops, key)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, key: int = 0) -> np.ndarray:
    """A hash of each word under a key, eight bytes of all words at a time.

    Every step puts eight more bytes through ``mix``, so that words which differ in one step have
    different hashes, and others meet by chance alone.
    """
    size = stops - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * _ODD + np.uint64(key))
    filled = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", filled, strides=(1,))
    if len(size) and size.min() > 0:
        # All words at once in the first step; of long ones nothing of this is kept.
        out = mix((out ^ (eight[starts] & _FIRST[np.minimum(size, 8)])) + _ODD)
        row, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    else:
        row, at = np.flatnonzero(size <= _LONG), 0
    while len(row := row[size[row] > at]):
        lane = eight[starts[row] + at] & _FIRST[np.minimum(size[row] - at, 8)]
        out[row] = mix((out[row] ^ lane) + _ODD)
        at += 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes(), seed=key)
    return out


def shingled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, in the order of their first word."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = (out + hashes[k : k + len(out)]) * np.uint64(0xA0761D6478BD642F)
        out ^= out >> np.uint64(32)
    return mix(out)


def whole(hashes: np.ndarray) -> int:
    """One hash for a whole sequence of words, apart from all hashes of runs."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=7)


class Shingles:
    """The set of each row: distinct runs of ``n`` words, or the whole sequence where it is shorter.

    ``values[first[i]:first[i + 1]]`` are the hashes of row i, ascending.
    """

    def __init__(self, column: pa.Array, n: int, lower: bool = True):
        words = Words(column, lower)
        runs = shingled(words.hashes, n)
        sets = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= n:
                part = np.sort(runs[a : b - n + 1])
                sets.append(part[np.concatenate(([True], part[1:] != part[:-1]))])
            elif b > a:
                sets.append(np.array([whole(words.hashes[a:b])], np.uint64))
            else:
                sets.append(np.empty(0, np.uint64))
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
        self.values = np.concatenate(sets) if sets else np.empty(0, np.uint64)

    def of(self, row: int) -> np.ndarray:
        return self.values[self.first[row] : self.first[row + 1]]
