"""Vectorised word tables over Arrow text columns.

A batch of texts is looked at as one array of UTF-8 bytes. Words, their hashes
and the hashes of word n-grams come from numpy passes over those bytes, with no
Python step per word. Hashes are 64 bits wide; callers that need identities
rather than candidates take both families (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text is looked at alone.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of any bytes but blanks: [^\x20\x09-\x0D]+
NON_BLANK = ~_SPACE
#: Words of digits, letters and all that is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Family:
    """One family of polynomial hashes modulo 2**64."""

    def __init__(self, seed: int):
        table = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))
        self.table = table
        self.base = int(mix64(np.array([seed + 77], dtype=np.uint64))[0]) | 1
        self.step = int(mix64(np.array([seed + 131], dtype=np.uint64))[0]) | 1
        self._powers = np.ones(1, np.uint64)

    def powers(self, n: int) -> np.ndarray:
        if len(self._powers) < n:
            p = np.full(max(n, 256), _U(self.base), dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                self._powers = np.cumprod(p, dtype=np.uint64)
        return self._powers


FAMILIES = (_Family(0x51ED2701), _Family(0x2545F491))


@dataclass
class Words:
    """Words of the texts lo..hi of a column. Word i is data[start[i]:end[i]]; text lo+d has the words off[d]..off[d+1]."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray

    def __post_init__(self):
        self._hash: dict[int, np.ndarray] = {}
        self._owner: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def owner(self) -> np.ndarray:
        """The number, from 0, of the text that holds each word."""
        if self._owner is None:
            self._owner = np.repeat(np.arange(self.hi - self.lo), self.counts)
        return self._owner

    def hashes(self, family: int = 0) -> np.ndarray:
        """A hash of each word's bytes."""
        if family not in self._hash:
            f = FAMILIES[family]
            if not len(self):
                self._hash[family] = np.zeros(0, np.uint64)
            else:
                size = self.end - self.start
                first = np.cumsum(size) - size
                inner = np.arange(int(size.sum())) - np.repeat(first, size)
                chars = self.data[inner + np.repeat(self.start, size)]
                value = f.table[chars] * f.powers(int(size.max()))[inner]
                self._hash[family] = mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * _U(f.step))
        return self._hash[family]

    def grams(self, n: int, family: int = 0) -> np.ndarray:
        """A hash of the n words from each word on; only meaningful where fits(n)."""
        return gram_hashes(self.hashes(family), n, family)

    def fits(self, n: int) -> np.ndarray:
        """Whether n words of the same text start at each word."""
        return np.arange(len(self)) + n <= np.repeat(self.off[1:], self.counts)


def gram_hashes(h: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Hashes of each n consecutive values, by doubling; the last n - 1 run over the end and mean nothing."""
    step = FAMILIES[family].step

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        if k < len(x):
            out[: len(x) - k] = x[k:]
        return out

    total, done, power, width, bits = np.zeros_like(h), 0, h, 1, n
    while bits:
        if bits & 1:
            total = total + shifted(power, done) * _U(pow(step, done, 1 << 64))
            done += width
        bits >>= 1
        if bits:
            power = power + shifted(power, width) * _U(pow(step, width, 1 << 64))
            width *= 2
    return mix64(total + _U(n))


def word_tables(column: pa.Array, kind: np.ndarray = NON_BLANK, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a text column, in pieces of about `chunk` bytes. Null counts as empty."""
    col = column.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    whole = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        data = whole[offsets[lo] : offsets[hi]]
        data = _LOWER[data] if lower else data
        edges = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        inside = kind[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges[:-1][edges[:-1] < len(data)]] = False
        after[edges[1:][edges[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield Words(lo, hi, data, start, end, np.searchsorted(start, edges))
        lo = hi


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after the other."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(first, lengths)
