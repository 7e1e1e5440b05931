"""Compressed full-text index of a shard's word sequences: FM-index over a wavelet tree, in NumPy.

Texts are laid end to end with a separator after each. Rows (suffixes) are sorted by their first
``DEPTH`` symbols by prefix doubling, which is enough for patterns of that length. The Burrows-Wheeler
transform is kept as a wavelet tree in matrix form: one packed bit vector a level with counts every 64
bits, so an index takes 1.5 bits a symbol and level. Searches run backwards for many patterns at a time.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class WaveletTree:
    """Rank queries on a sequence of symbols below ``size``."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels):
            bit = ((now >> (self.levels - 1 - level)) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(now) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            self.bits.append(words)
            self.counts.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(np.bitwise_count(words), dtype=np.int32)]))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        everything = np.arange(size)
        self.first = self.walk(everything, np.zeros(size, np.int64))

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the positions ``at`` lie among the symbols' occurrences at the lowest level."""
        one = np.uint64(1)
        for level in range(self.levels):
            word = at >> 6
            below = (one << (at & 63).astype(np.uint64)) - one
            ones = self.counts[level][word] + np.bitwise_count(self.bits[level][word] & below)
            bit = (symbols >> (self.levels - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self.walk(symbols, at) - self.first[symbols]


def suffix_rows(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in the order of their first ``DEPTH`` symbols, and their ranks by 1, 2, 4, ... symbols (with one more for the end)."""
    n = len(text)
    rank = np.append(text.astype(np.int64) + 1, 0)
    ranks, k, order = [rank], 1, np.argsort(rank[:n])
    while k < DEPTH:
        second = np.zeros(n, np.int64)
        second[:max(n - k, 0)] = rank[k:n]
        key = rank[:n] * (int(rank.max()) + 1) + second
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.cumsum(np.concatenate([np.ones(min(1, n), bool), ordered[1:] != ordered[:-1]]))
        ranks.append(rank)
        k *= 2
    return order, ranks


class FMIndex:
    """Index of ``texts`` (symbols from 1; ``sizes`` of the texts laid end to end), each with an ``owner`` number.

    ``cap`` (at most ``DEPTH``) is the longest match that is looked for.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, owner: np.ndarray, cap: int):
        ends = np.cumsum(sizes)
        text = np.insert(symbols, ends, 0)
        self.n, self.cap = len(text), cap
        self.size = int(text.max()) + 1 if len(text) else 1
        self.rows, self.ranks = suffix_rows(text)
        self.tree = WaveletTree(text[self.rows - 1], self.size)     # the symbol before each suffix
        smaller = np.cumsum(np.bincount(text, minlength=self.size)) - np.bincount(text, minlength=self.size)
        self.base = smaller - self.tree.first
        # rows that share their first `cap` symbols, and the least owner of each such group
        new = np.ones(self.n, bool)
        new[1:] = self.common() < cap
        self.group = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], self.n)
        owners = np.repeat(owner, sizes + 1)[self.rows]
        self.least = np.minimum.reduceat(owners, self.begin) if self.n else owners
        self.tables: tuple[list[np.ndarray], list[np.ndarray]] | None = None

    def common(self) -> np.ndarray:
        """Common symbols of each row and the one before it, up to ``DEPTH``."""
        a, b = self.rows[:-1], self.rows[1:]
        out = np.zeros(max(self.n - 1, 0), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):        # steps of 32, 16, ... 1
            same = self.ranks[k][np.minimum(a + out, self.n)] == self.ranks[k][np.minimum(b + out, self.n)]
            out += same.astype(np.int64) << k
        return np.where(self.ranks[-1][a] == self.ranks[-1][b], DEPTH, out)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with a symbol followed by what rows lo..hi begin with (symbol -1: none)."""
        known = symbols >= 0
        s = np.where(known, symbols, 0)
        at = self.tree.walk(np.concatenate([s, s]), np.concatenate([lo, hi])) + np.concatenate([self.base[s], self.base[s]])
        lo2, hi2 = at[:len(s)], at[len(s):]
        return lo2, np.where(known, hi2, lo2)

    def _tables(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least common lengths of 1, 2, 4, ... neighbouring rows, to the left and to the right of each border."""
        if self.tables is None:
            lcp = np.full(self.n + 1, -1, np.int8)
            lcp[1:self.n] = self.common()
            left, right, k = [lcp], [lcp], 1
            while k <= self.n:
                for side, keep in ((left, slice(k, None)), (right, slice(None, -k))):
                    now = np.full(self.n + 1, -1, np.int8)
                    other = slice(None, -k) if side is left else slice(k, None)
                    now[keep] = np.minimum(side[-1][keep], side[-1][other])
                    side.append(now)
                k *= 2
            self.tables = left, right
        return self.tables

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider rows that share a shorter start, and how long that is."""
        left, right = self._tables()
        size = np.maximum(left[0][lo], left[0][hi]).astype(np.int64)
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(left) - 1, -1, -1):
            lo = np.where(left[k][lo] >= np.maximum(size, 0), lo - (1 << k), lo)
            hi = np.where(right[k][hi] >= np.maximum(size, 0), hi + (1 << k), hi)
        return lo, hi, np.maximum(size, 0)

    def matching_statistics(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every position of the patterns laid end to end: the longest match that starts there (up to ``cap``), and a row that has it.

        Patterns are walked from their ends, all at once: a match grows by the symbol before it; where no
        row has that, its end is cut back to the next wider rows until one has.
        """
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)[order]
        length, row = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        lo, hi, size = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        by_size = sizes[order]
        for step in range(int(sizes.max()) if len(sizes) else 0):
            live = int(np.searchsorted(-by_size, -step))    # the longer ones come first
            at = ends[:live] - 1 - step
            s = symbols[at]
            l2, h2 = self.extend(s, lo[:live], hi[:live])
            size[:live] += 1
            bad = np.flatnonzero(h2 <= l2)
            while len(bad):
                out = size[bad] == 1                        # the symbol itself is in no text
                gone = bad[out]
                l2[gone], h2[gone], size[gone] = 0, self.n, 0
                bad = bad[~out]
                lo[bad], hi[bad], size[bad] = self.parent(lo[bad], hi[bad])
                l2[bad], h2[bad] = self.extend(s[bad], lo[bad], hi[bad])
                size[bad] += 1
                bad = bad[h2[bad] <= l2[bad]]
            over = np.flatnonzero(size[:live] > self.cap)   # the first `cap` symbols of the match
            group = self.group[l2[over]]
            l2[over], h2[over], size[over] = self.begin[group], self.end[group], self.cap
            lo[:live], hi[:live] = l2, h2
            length[at], row[at] = size[:live], l2
        return length, row
