"""A compressed FM-index over word sequences: a wavelet matrix of packed bits, searched for many patterns in step."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank in two reads."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64)))).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        low = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (values >> shift & 1).astype(np.uint8)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((Bits(bit), zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        at = np.arange(symbols)
        self.start = self._walk(np.zeros(symbols, np.int64), at)

    def _walk(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place i."""
        return self._walk(i, symbol) - self.start[symbol]


class FmIndex:
    """Index of a text of codes (0 separates) whose suffixes are ordered to `depth` words.

    group(d): for every place of the suffix order, where its group of suffixes that
    share their first d words begins and ends.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        n = len(text)
        self.symbols = int(text.max(initial=0)) + 1
        self.order, self.shared = ordered(text, depth)
        self.matrix = WaveletMatrix(text[self.order - 1], self.symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.symbols))))
        self.n = n

    def group(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        head = np.flatnonzero(self.shared < d)
        size = np.diff(np.append(head, self.n))
        return np.repeat(head, size), np.repeat(head + size, size)

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of symbol + pattern."""
        k = len(symbol)
        both = self.first[np.concatenate([symbol, symbol])] + self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[:k], both[k:]


def ordered(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order by the first `depth` words at least, words that each suffix shares with the one before, up to `depth`)."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = [np.empty(n, np.int32)]
    key = text[order]
    ranks[0][order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    k = 1
    while k < depth:
        rank = ranks[-1].astype(np.int64)
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        ranks.append(rank)
        k *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        size = 1 << level
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        common[same] += size
        a[same] += size
        b[same] += size
    return order, np.concatenate(([0], np.minimum(common, depth)))
