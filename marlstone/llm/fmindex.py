"""A compressed FM-index over sequences of words: Burrows-Wheeler transform in a wavelet matrix.

What is kept is the wavelet matrix, two bitmaps that mark where groups of suffixes with the same
first words begin, and one value for each group; the suffix order is dropped once these are built.

All searches of a call move together, one word a step, as numpy operations over the whole set
of searches; the bitmaps of the wavelet matrix are packed, with a rank directory over them.
"""

from __future__ import annotations

import numpy as np


class Bitmap:
    """Packed bits with the number of set bits before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.ranks = np.cumsum(counts, dtype=np.int64) - counts
        self.ones = int(counts.sum())
        self.size = len(bits)
        self.zeros = len(bits) - self.ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[at] + np.bitwise_count(self.words[at] & mask)


    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th set bit, counted from 0; the number of bits where there is none."""
        inside = k < self.ones
        k = np.where(inside, k, 0)
        at = np.searchsorted(self.ranks, k, "right") - 1
        bits = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        among = np.cumsum(bits, axis=1, dtype=np.uint8) == (k - self.ranks[at] + 1)[:, None]
        return np.where(inside, at * 64 + among.argmax(1), self.size)


class WaveletMatrix:
    """Occurrences of a symbol before a place, in one step for each bit of the symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        """symbols: integers from 0 to size - 1."""
        self.levels: list[Bitmap] = []
        self.bits = max(1, int(size - 1).bit_length())
        now = symbols
        for k in range(self.bits - 1, -1, -1):
            bit = (now >> k & 1).astype(bool)
            self.levels.append(Bitmap(bit))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(size)
        self.start = self._follow(every, np.zeros(size, np.int64))

    def _follow(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = level.rank(i)
            i = np.where(symbols >> k & 1, level.zeros + ones, i - ones)
        return i

    def occurrences(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._follow(symbols, i) - self.start[symbols]


class FMIndex:
    """An index of word sequences that gives capped matching statistics of sequences streamed through it.

    words: all sequences in a row (any integers). first: where each starts, and the end.
    length: what a match is capped at, 17 to 32 words. values: a number for each word; of the words
    that full-length matches of one group start at, the index keeps the least as ``least``.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, length: int, values: np.ndarray | None = None):
        if not 16 < length <= 32:
            raise ValueError("length must be 17 to 32")
        self.length = length
        self.alphabet, codes = np.unique(words, return_inverse=True)
        n_seq, sizes = len(first) - 1, np.diff(first)
        # A separator after each sequence, all different and before all words in order.
        seq = np.repeat(np.arange(n_seq), sizes)
        n = len(words) + n_seq
        place = np.arange(len(words)) + seq  # of each word in the indexed text
        text = np.zeros(n, np.int64)
        text[place] = codes + 1
        rank = np.empty(n, np.int64)
        rank[place] = codes + n_seq
        ends = first[1:] + np.arange(n_seq)
        rank[ends] = np.arange(n_seq)
        order, rank16 = self._suffixes(rank, n)
        self.matrix = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)  # order 0 takes the last separator
        counts = np.bincount(codes, minlength=len(self.alphabet))
        self.before = np.concatenate([[0, n_seq], n_seq + np.cumsum(counts)])[: len(self.alphabet) + 1]
        self.n = n
        self.shorter = Bitmap(self._new(order, rank16, length - 1))
        new = self._new(order, rank16, length)
        self.full = Bitmap(new)
        at = np.full(n, np.iinfo(np.int64).max)
        at[place] = np.arange(len(words)) if values is None else values
        self.least = np.minimum.reduceat(at[order], np.flatnonzero(new))

    @staticmethod
    def _suffixes(rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix order by prefix doubling, and the rank of each place by its first 16 symbols."""
        k, rank16 = 1, None
        order = np.argsort(rank, kind="stable")
        while True:
            new = np.empty(n, np.int64)
            step = np.concatenate([[0], (rank[order][1:] != rank[order][:-1]).cumsum()])
            new[order] = step
            rank = new
            if k == 16:
                rank16 = rank
            if step[-1] == n - 1:
                return order, rank if rank16 is None else rank16
            ahead = np.zeros(n, np.int64)
            ahead[: n - k] = rank[k:] + 1
            rank = rank * (n + 1) + ahead
            order = np.argsort(rank, kind="stable")
            k *= 2

    @staticmethod
    def _new(order: np.ndarray, rank16: np.ndarray, length: int) -> np.ndarray:
        """Of each suffix in order: whether its first words differ from those of the one before."""
        padded = np.concatenate([rank16, np.full(16, -1)])
        a, b = padded[order], padded[order + length - 16]
        return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams sequences backward through the index.

        Returns for each word the length of the longest match that starts there (at most
        ``length``), and for full-length ones the group of the match (else -1). A match that
        cannot grow to the left is cut on the right until it can.
        """
        known = np.searchsorted(self.alphabet, words)
        known[known == len(self.alphabet)] = 0
        code = np.where(self.alphabet[known] == words, known + 1, 0) if len(self.alphabet) else np.zeros(len(words), np.int64)
        stat, group = np.zeros(len(words), np.int64), np.full(len(words), -1)
        at = first[1:] - 1
        live = np.flatnonzero(at >= first[:-1])
        lo, hi, size = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        while len(live):
            place = at[live]
            full = live[size[live] == self.length]
            if len(full):  # the first words of a full match, one fewer: a group that is known beforehand
                g = self.shorter.rank(lo[full] + 1) - 1
                lo[full], hi[full], size[full] = self.shorter.select(g), self.shorter.select(g + 1), self.length - 1
            c = code[place]
            self._extend(live, c, lo, hi, size, words, place)
            stat[place] = size[live]
            done = size[live] == self.length
            group[place[done]] = self.full.rank(lo[live[done]] + 1) - 1
            at[live] -= 1
            live = live[at[live] >= first[:-1][live]]
        return stat, group

    def _extend(self, live, c, lo, hi, size, words, place) -> None:
        """Grows each match by the word to its left; where it doesn't occur, searches the shorter matches anew."""
        a = self.before[c] + self.matrix.occurrences(c, lo[live])
        b = self.before[c] + self.matrix.occurrences(c, hi[live])
        ok = (b > a) & (c > 0)
        lo[live[ok]], hi[live[ok]], size[live[ok]] = a[ok], b[ok], size[live[ok]] + 1
        for i, p in zip(live[~ok].tolist(), place[~ok].tolist(), strict=True):
            # Longest match of words[p:] that is shorter than what failed: by backward search of each length, halving.
            best, low, high = (0, self.n, 0), 0, int(size[i])
            while low < high:
                mid = (low + high + 1) // 2
                x, y = self.interval(words[p : p + mid])
                if y > x:
                    best, low = (x, y, mid), mid
                else:
                    high = mid - 1
            lo[i], hi[i], size[i] = best

    def interval(self, words: np.ndarray) -> tuple[int, int]:
        """The suffixes that start with the words, as a range of the suffix order."""
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n)
        for w in words[::-1]:
            k = int(np.searchsorted(self.alphabet, w))
            if k == len(self.alphabet) or self.alphabet[k] != w:
                return 0, 0
            c = np.array([k + 1])
            lo = self.before[c] + self.matrix.occurrences(c, lo)
            hi = self.before[c] + self.matrix.occurrences(c, hi)
            if hi[0] <= lo[0]:
                return 0, 0
        return int(lo[0]), int(hi[0])
