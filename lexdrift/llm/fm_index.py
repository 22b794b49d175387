"""An FM-index over sequences of word numbers, compressed as a wavelet matrix.

Backward search narrows, for many patterns at a time, the range of sorted
suffixes that begin with what has been read so far from the right.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


class Bits:
    """A bit vector in 64-bit words with the ones before each word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype="i8")]).astype("i4")
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Occurrences of a symbol before a place, one bit of the symbol at a time from the highest."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        rest = symbols
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (rest >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            rest = np.concatenate([rest[~ones], rest[ones]])

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query: occurrences before ``low`` and before ``high``, counted from the third value, the symbol's own start."""
        start = np.zeros(len(symbols), "i8")
        for bit, bits in self.levels:
            right = (symbols >> bit & 1).astype(bool)
            s1, l1, h1 = bits.ones(start), bits.ones(low), bits.ones(high)
            start = np.where(right, bits.zeros + s1, start - s1)
            low = np.where(right, bits.zeros + l1, low - l1)
            high = np.where(right, bits.zeros + h1, high - h1)
        return low - start, high - start, start


class FmIndex:
    """Index of ``text``: word numbers from 1, sequences ended by ``SEPARATOR``. Suffixes are sorted by their first ``order`` words at least."""

    def __init__(self, text: np.ndarray, order: int):
        self.size = len(text)
        self.suffixes = sorted_suffixes(text, order)
        largest = int(text.max(initial=0))
        self.wavelet = WaveletMatrix(text[self.suffixes - 1], largest)
        counts = np.bincount(text, minlength=largest + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def extend(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put each pattern's next word to the left before it."""
        a, b, _ = self.wavelet.ranks(words, low, high)
        return self.first[words] + a, self.first[words] + b

    def matching(self, stream: np.ndarray, ends: np.ndarray, most: int, alone: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at ``ends`` (exclusive) of ``stream``, up to ``most`` words.

        How many words that end there occur together in the index, and the
        range of suffixes that they begin. A pattern found ``alone`` times or
        fewer is given up: a stream that is part of the index itself passes 1.
        Words that the index lacks, and separators, are matched by nothing.
        """
        low, high = np.zeros(len(ends), "i8"), np.full(len(ends), self.size, "i8")
        length = np.zeros(len(ends), "i4")
        live = np.arange(len(ends))
        for k in range(1, most + 1):
            at = ends[live] - k
            words = np.where(at >= 0, stream[np.maximum(at, 0)], SEPARATOR)
            known = (words > SEPARATOR) & (words < len(self.first) - 1)
            live, words = live[known], words[known]
            a, b = self.extend(words, low[live], high[live])
            found = b - a > alone
            live, a, b = live[found], a[found], b[found]
            low[live], high[live], length[live] = a, b, k
            if not len(live):
                break
        return length, low, high


def sorted_suffixes(text: np.ndarray, order: int) -> np.ndarray:
    """Suffix array by doubling the sorted length until ``order`` words or all differ. The text is taken as cyclic; it ends with a separator."""
    n, sorted_words = len(text), 1
    rank = text.astype("i8")
    while True:
        key = rank * (n + 2) + np.roll(rank, -sorted_words) if sorted_words < n else rank
        places = np.argsort(key, kind="stable")
        new = np.empty(n, "i8")
        new[places] = np.concatenate([[0], np.cumsum(np.diff(key[places]) != 0)])
        rank, sorted_words = new, sorted_words * 2
        if sorted_words >= order or (n and rank[places[-1]] == n - 1):
            return places
