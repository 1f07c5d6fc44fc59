"""A wavelet matrix: rank queries over a sequence of small symbols, many at once."""

from __future__ import annotations

import numpy as np

WORD = 64


class Bits:
    """A bit vector that counts the ones before any positions."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // WORD + 1) * WORD, bool)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at // WORD, (at % WORD).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    """Symbols below 2**levels, one bit vector a level from the highest bit down.

    Going down a level keeps the order of the zeros and puts the ones behind them all.
    """

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), []
        for bit in range(levels - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append(Bits(ones))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``, for every position of ``at``."""
        low, high = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for depth, bits in enumerate(self.levels):
            if symbol >> (len(self.levels) - 1 - depth) & 1:
                zeros = bits.n - bits.ones
                low, high = zeros + bits.rank(low), zeros + bits.rank(high)
            else:
                low, high = low - bits.rank(low), high - bits.rank(high)
        return high - low
