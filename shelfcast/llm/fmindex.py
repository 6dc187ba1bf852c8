"""FM-index over word ids: suffix array, wavelet ranks, sampled positions.

Everything is numpy over one shard of a bounded number of words; patterns are
searched together, one backward step at a time.
"""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``t``, whose last symbol is its only 0.
    Prefix doubling that sorts only the suffixes still tied."""
    n, base = len(t), int(t.max()) + 1
    width = 3 if base < 1 << 20 else 2
    key = t.astype(np.int64)
    for k in range(1, width):
        key *= base
        key[:n - k] += t[k:]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    del sorted_key, key
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))      # places in groups of two or more
    h = width
    while len(slots):
        p = order[slots]
        ahead = p + h
        own = rank[p]
        key = own * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        p, key, own = p[by], key[by], own[by]
        order[slots] = p
        new = np.empty(len(p), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[p] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class Ranks:
    """Wavelet matrix: rank and access over a sequence of symbols."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.n, self.bits = len(s), max(1, int(sigma - 1).bit_length())
        self.counts = np.bincount(s, minlength=sigma).astype(np.int64)
        self.words, self.sums, self.zeros = [], [], []
        for b in range(self.bits - 1, -1, -1):
            one = (s >> b & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(one, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view("<u8")
            sums = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=sums[1:])
            self.words.append(words)
            self.sums.append(sums)
            self.zeros.append(self.n - int(one.sum()))
            s = np.concatenate([s[~one], s[one]])
        # Where a symbol's block begins below the last level: symbols in order of their reversed bits.
        c, rev = np.arange(sigma), np.zeros(sigma, np.int64)
        for b in range(self.bits):
            rev |= (c >> b & 1) << (self.bits - 1 - b)
        by = np.argsort(rev, kind="stable")
        self.starts = np.zeros(sigma, np.int64)
        self.starts[by] = np.cumsum(self.counts[by]) - self.counts[by]

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        w, low = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.sums[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol c[i] occurs before place at[i]."""
        at = at.astype(np.int64)
        for level in range(self.bits):
            ones = self._ones(level, at)
            at = np.where(c >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at - self.starts[c]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        c, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            c = c << 1 | bit
        return c, at - self.starts[c]


class FMIndex:
    """Index of a sequence of word ids from 1 to sigma - 1."""

    def __init__(self, words: np.ndarray, sigma: int, sample: int = 16):
        t = np.append(words, 0).astype(np.int64)
        order = suffix_array(t)
        self.ranks = Ranks(t[order - 1], sigma)
        self.before = np.cumsum(self.ranks.counts) - self.ranks.counts
        marked = order % sample == 0
        self.marked_before = np.cumsum(marked) - marked
        self.marked, self.samples = marked, order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each row of ``patterns``."""
        lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        c = patterns[:, -1]
        lo[:], hi[:] = self.before[c], self.before[c] + self.ranks.counts[c]
        alive = np.flatnonzero(lo < hi)
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[alive, k]
            both = self.ranks.rank(np.concatenate([c, c]), np.concatenate([lo[alive], hi[alive]]))
            lo[alive], hi[alive] = self.before[c] + both[:len(c)], self.before[c] + both[len(c):]
            alive = alive[lo[alive] < hi[alive]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps back to a sample."""
        out, steps = np.zeros(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            here = self.marked[at]
            out[todo[here]] = self.samples[self.marked_before[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            if len(todo):
                c, r = self.ranks.access(at)
                at = self.before[c] + r
            steps += 1
        return out
