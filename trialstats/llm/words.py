"""Words and shingles of many texts at once, in NumPy.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(0x20, 0x09-0x0D); ASCII letters are lower-cased first where asked for. A word
is known by a 64-bit polynomial hash of its bytes, a shingle by a mixed 64-bit
hash of its five word hashes. The polynomial is taken modulo 2^64, so texts built against
it can collide (its low bits are weak); for other texts two different words or
shingles get one hash in about one of 2^64 pairs, far below what could move a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHINGLE_WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


@dataclass
class Words:
    """Words of a run of texts: byte range and hash of each, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Index of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


class WordHasher:
    """Splits and hashes; keeps the powers of the hash base between calls."""

    def __init__(self) -> None:
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)
        self._byte = _multipliers(256, 0xA0761D6478BD642F)

    def _grow(self, n: int) -> None:
        if len(self._power) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                out = np.full(size, np.uint64(base))
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def __call__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, cuts: np.ndarray | None = None) -> Words:
        """Words of the texts ``data[offsets[i]:offsets[i+1]]``; ``cuts``: bytes before which a word also ends."""
        if lower and len(data):
            data = _LOWER[data]
        start, end, first = self.split(data, offsets, cuts)
        return Words(start, end, self.ranges(data, start, end) if len(data) else np.zeros(0, np.uint64), first)

    def split(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of the words, and the index of each text's first word; one more at the end."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if cuts is not None:
            edge[:n] |= cuts
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, offsets)

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte strings ``data[start[i]:end[i]]``."""
        return self.between(self.totals(data), start, end)

    def totals(self, data: np.ndarray) -> np.ndarray:
        """What ``between`` needs of the bytes; for several calls on the same data."""
        n = len(data)
        self._grow(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self._byte[data] * self._power[:n], out=total[1:])
        return total

    def between(self, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte strings from ``start[i]`` to ``end[i]`` of the data with these totals."""
        return mix64((total[end] - total[start]) * self._inverse[start] + (end - start).astype(np.uint64))


_SHINGLE = _multipliers(SHINGLE_WORDS, 0xE7037ED1A0B428DB)


def shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of the word 5-grams in order, repeats included.

    A text of one to four words has its whole sequence as its one shingle, a text
    without words has none.
    """
    k, counts, h = SHINGLE_WORDS, words.counts, words.hash
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n_out, out=at[1:])
    out = np.zeros(at[-1], np.uint64)
    if len(h) >= k:
        m = len(h) - k + 1
        roll = h[:m] * _SHINGLE[0]
        for j in range(1, k):
            roll += h[j:m + j] * _SHINGLE[j]
        long = counts >= k
        of = np.repeat(np.arange(len(counts))[long], n_out[long])
        where = np.arange(len(of)) - np.repeat((np.cumsum(n_out * long) - n_out * long)[long], n_out[long])
        out[at[of] + where] = roll[words.first[of] + where]
    for size in range(1, k):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            value = np.full(len(rows), np.uint64(size))
            for j in range(size):
                value += h[words.first[rows] + j] * _SHINGLE[j]
            out[at[rows]] = value
    return mix64(out + np.uint64(1)), at


def distinct_by_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, with their offsets."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, text))
    values = values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    counts = np.bincount(text[keep], minlength=len(offsets) - 1)
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=at[1:])
    return values[keep], at
