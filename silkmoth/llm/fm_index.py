"""FM-index over sequences of small integers: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: A suffix position is kept for every so many text positions.
SAMPLE = 4


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` by prefix doubling; ``s`` ends with a value that is smallest and unique."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1 or h >= n:
            return order
        h *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit a level."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = s.astype(np.int64)
        every = np.arange(sigma, dtype=np.int64)
        lo = np.zeros(sigma, np.int64)  # where each symbol's range begins, level by level
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            r = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            zeros = int(len(bit) - r[-1])
            self.ranks.append(r)
            self.zeros.append(zeros)
            a = r[lo].astype(np.int64)
            lo = np.where((every >> b) & 1 == 1, zeros + a, lo - a)
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.begin = lo

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` before each position ``at``."""
        hi = at.astype(np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            z = self.ranks[level][hi].astype(np.int64)
            hi = np.where((symbol >> b) & 1 == 1, self.zeros[level] + z, hi - z)
        return hi - self.begin[symbol]


class FMIndex:
    """Index of one text of symbols ``1 .. sigma-1``; 0 is kept for its end."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        s = np.append(text, 0).astype(np.int64)
        self.n = len(s)
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))]).astype(np.int64)
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        kept = sa % sample == 0
        self.marked = kept
        self.before = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
        self.samples = sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of ``patterns``, all of one length, by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k]
            lo = self.first[c] + self.wavelet.rank(c, lo)
            hi = self.first[c] + self.wavelet.rank(c, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, walking back to the next sampled one."""
        at = at.astype(np.int64).copy()
        steps = np.zeros(len(at), np.int64)
        todo = np.flatnonzero(~self.marked[at])
        while len(todo):
            c = self.bwt[at[todo]]
            at[todo] = self.first[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[~self.marked[at[todo]]]
        return self.samples[self.before[at]] + steps
