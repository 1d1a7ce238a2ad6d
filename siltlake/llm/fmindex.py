"""A compressed full-text index in numpy: wavelet matrix, backward search for many
positions at once."""

from __future__ import annotations

import numpy as np

BLOCK = 2  # 64-bit words between counts


class WaveletMatrix:
    """Rank over a sequence of symbols: a bit vector a level, with a four-byte count
    before every ``BLOCK`` words of it."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n, self.levels = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s = symbols.astype("u4")
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> np.uint32(level) & np.uint32(1)).astype("u1")
            padded = np.zeros((self.n // (64 * BLOCK) + 1) * 64 * BLOCK, "u1")
            padded[: self.n] = bit
            word = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(word).reshape(-1, BLOCK).sum(1, dtype="u4")
            self.words.append(word)
            self.before.append(np.cumsum(ones, dtype="u4") - ones)
            self.zeros.append(self.n - int(ones.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.start = self._down(np.arange(n_symbols), np.zeros(n_symbols, "i8"))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            at = i >> 6
            block = at // BLOCK
            mask = (np.uint64(1) << (i & 63).astype("u8")) - np.uint64(1)
            ones = self.before[k][block].astype("i8") + np.bitwise_count(self.words[k][at] & mask)
            odd = np.flatnonzero(at % BLOCK)  # the word of the block that stands before
            ones[odd] += np.bitwise_count(self.words[k][at[odd] - 1])
            i = np.where(c >> level & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before position i."""
        return self._down(c, i) - self.start[c]


class FMIndex:
    """Over texts of whole numbers from 1; texts end in 0.  Suffixes are sorted by their
    first ``order`` symbols, which is all that matches up to that length need.  Of the
    suffix array only the owner of each suffix is kept (``owner`` has that of each
    position, a small number), not its place."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, order: int):
        self.n = len(text)
        n_symbols = int(text.max(initial=0)) + 1
        rank, h = text.astype("i8"), 1
        while h < order:
            after = np.zeros(self.n, "i8")
            after[: self.n - h] = rank[h:] + 1
            _, rank = np.unique(rank * (rank.max(initial=0) + 2) + after, return_inverse=True)
            h *= 2
        sa = np.argsort(rank, kind="stable")
        self.owner = owner[sa].astype("u4")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.bwt = WaveletMatrix(text[sa - 1], n_symbols)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high): for each position of ``text`` (exclusive end) the length, up
        to ``most``, of the longest match that ends there and occurs ``least`` times or
        more, and the suffix range of that match where it is ``most`` long.  Backward
        search for all positions at once; one leaves when its range gets too small."""
        length = np.zeros(len(ends), "i4")
        low, high = np.zeros(len(ends), "i8"), np.zeros(len(ends), "i8")
        which, a, b = np.arange(len(ends)), np.zeros(len(ends), "i8"), np.full(len(ends), self.n)
        for j in range(1, most + 1):
            c = text[ends[which] - j]
            a, b = (self.first[c], self.first[c + 1]) if j == 1 else (self.first[c] + self.bwt.rank(c, a), self.first[c] + self.bwt.rank(c, b))
            keep = (b - a >= least) & (c > 0)
            which, a, b = which[keep], a[keep], b[keep]
            length[which] = j
        low[which], high[which] = a, b
        return length, low, high

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner in each suffix range; equal ranges are looked at once."""
        if not len(low):
            return np.zeros(0, "i8")
        ranges, back = np.unique(low, return_inverse=True)
        upper = np.zeros(len(ranges), "i8")
        upper[back] = high
        owner = np.append(self.owner, np.uint32(0xFFFFFFFF))
        return np.minimum.reduceat(owner, np.stack([ranges, upper], 1).reshape(-1))[::2][back].astype("i8")
