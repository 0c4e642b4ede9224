"""A wavelet matrix: rank of any symbol before any position of a sequence of small numbers.

Level by level, from the highest bit down, the sequence's bits are packed into 64-bit words with a
running count of ones at each word; then the sequence is parted stably, zeros first. A rank walks one
position down the levels. All queries take arrays and are answered together.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with counts of the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Ranks over ``symbols``, each below ``2 ** bits``."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.levels = len(symbols), []
        for shift in range(bits - 1, -1, -1):
            ones = (symbols >> shift) & 1 == 1
            vector = BitVector(ones)
            self.levels.append((shift, vector, len(symbols) - int(np.count_nonzero(ones))))
            if shift:
                symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` lie before each position."""
        low, high = np.zeros_like(at), at
        for shift, vector, zeros in self.levels:
            low_ones, high_ones = vector.ones(low), vector.ones(high)
            low, high = (zeros + low_ones, zeros + high_ones) if symbol >> shift & 1 else (low - low_ones, high - high_ones)
        return high - low


def first_reaching(count, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By bisection, the least position in ``low..high`` at which the growing ``count`` is ``wanted`` or more.

    ``high`` where it is nowhere reached.
    """
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        reached = count(middle) >= wanted
        high = np.where(open_ & reached, middle, high)
        low = np.where(open_ & ~reached, middle + 1, low)
    return low
