"""A compressed FM-index over a sequence of integer symbols, for patterns of bounded length.

Suffixes are sorted by their first ``depth`` symbols, which is enough for backward search with patterns of at most ``depth``
symbols: the range of a pattern holds all rows that begin with it, whatever the order of rows that agree in ``depth``
symbols. The transformed sequence is held in a wavelet tree in its levelwise (matrix) form: a packed bit vector and one count
for each 64 bits of each level. All queries of a batch go through the levels together.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with rank by a block count and a popcount."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((n // 64 + 1) * 8, dtype=np.uint8)
        words[: len(packed)] = packed
        self.words = words.view("<u8")
        self.counts = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.counts[1:])
        self.zeros = n - int(np.count_nonzero(bits))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block] + np.bitwise_count(self.words[block] & mask)


class WaveletTree:
    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, BitVector]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, BitVector(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before two places each."""
        start = np.zeros(len(symbol), dtype=np.int64)
        for shift, bits in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            ranks = [bits.rank(x) for x in (start, low, high)]
            start, low, high = (np.where(one, bits.zeros + r, x - r) for r, x in zip(ranks, (start, low, high)))
        return low - start, high - start


class FMIndex:
    def __init__(self, symbols: np.ndarray, depth: int = 16) -> None:
        symbols = symbols.astype(np.int64)
        n = len(symbols)
        self.sigma = int(symbols.max(initial=0)) + 1
        rank, reach = symbols, 1
        while reach < depth and n:
            after = np.zeros(n, dtype=np.int64)
            after[:-reach] = rank[reach:] + 1
            rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.tree = WaveletTree(symbols[self.suffixes - 1], self.sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma))])
        self.n = n

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with one symbol more in front."""
        a, b = self.tree.rank(symbol, low, high)
        first = self.before[symbol]
        return first + a, first + b

    def matches(self, symbols: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each place ``end`` of a streamed sequence, the length (at most ``most``) of the longest
        match that ends there, and its range of suffixes. Symbol 0 parts sequences and matches nothing."""
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        length, live = np.zeros(len(ends), dtype=np.int64), np.arange(len(ends))
        for step in range(1, most + 1):
            at = ends[live] - step
            live = live[at >= 0]
            symbol = symbols[ends[live] - step]
            known = (symbol > 0) & (symbol < self.sigma)
            live, symbol = live[known], symbol[known]
            if not len(live):
                break
            a, b = self.backward(symbol, low[live], high[live])
            full = b > a
            live = live[full]
            low[live], high[live], length[live] = a[full], b[full], step
        return length, low, high
