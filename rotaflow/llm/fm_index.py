"""A compressed full-text index of word sequences, built and searched with numpy.

The Burrows-Wheeler transform is held in a wavelet matrix: a bit per symbol and level with a counter per 64
bits. Backward search runs for many patterns in lockstep, one word further to the left per step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


class WaveletMatrix:
    """Ranks of symbols in a sequence of non-negative integers."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        values = symbols.astype(np.int64)
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (values >> shift & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            zeros = len(values) - int(counts[-1])
            self.levels.append((shift, packed, counts, zeros))
            values = np.concatenate([values[~bits], values[bits]])

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word].astype(np.int64) + np.bitwise_count(packed[word] & below)

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each end."""
        places = [np.zeros(len(symbol), np.int64), *ends]
        for shift, packed, counts, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            for k, at in enumerate(places):
                ones = self._ones(packed, counts, at)
                places[k] = np.where(one, zeros + ones, at - ones)
        return [at - places[0] for at in places[1:]]


class FmIndex:
    """Index of several word sequences; ``window`` is the length from which matches count."""

    def __init__(self, texts: list[str], window: int):
        """Texts of words joined by single blanks."""
        words = [t.split(" ") for t in texts]
        self.length = np.array([len(w) for w in words], np.int64)
        ids, names = pd.factorize(np.array([w for ws in words for w in ws], object))
        self.names, self.window = pd.Index(names), window
        self.start = np.cumsum(np.concatenate([[0], self.length[:-1] + 1]))  # a separator behind each text
        size = int(self.length.sum()) + len(texts)
        text = np.zeros(size, np.int64)
        inside = np.ones(size, bool)
        inside[self.start + self.length] = False
        text[inside] = ids + 1
        self.text = text
        order = self._sorted(text, inside)
        previous = text[order - 1]
        sigma = len(names) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(previous, sigma)
        self.order = order

    def _sorted(self, text: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Places of the sorted suffixes (doubling), and the classes of those that share their first ``window`` words."""
        rank = np.where(inside, text + np.count_nonzero(~inside), 0)
        rank[~inside] = np.arange(np.count_nonzero(~inside))  # separators differ, so no match runs over one
        size, step = len(text), 1
        rank = np.unique(rank, return_inverse=True)[1]
        at_window = None
        while True:
            if at_window is None and 2 * step > self.window:
                more = np.concatenate([rank[self.window - step :], np.full(self.window - step, -1)])
                at_window = (rank.copy(), more)
            if rank.max(initial=0) == size - 1:
                break
            ahead = np.concatenate([rank[step:], np.full(min(step, size), -1)])[:size] + 1
            key = rank * (size + 1) + ahead
            order = np.argsort(key, kind="stable")
            new = np.empty(size, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank, step = new, step * 2
        order = np.empty(size, np.int64)
        order[rank] = np.arange(size)
        if at_window is None:  # all suffixes differ before that length
            at_window = (rank, rank)
        a, b = at_window[0][order], at_window[1][order]
        self.group = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        return order

    def matches(self, patterns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per pattern (word ids, 0 for unknown words): the matching statistics from its end, as (match length, class) at each place.

        The search extends matches to the left. Where a match cannot be extended, the ``window`` words from that place on are searched
        anew; if they don't occur either, the length is given as 0, and so on at the next place. Classes are -1 below ``window``.
        """
        size = np.array([len(p) for p in patterns], np.int64)
        flat = np.concatenate([*patterns, np.zeros(0, np.int64)])
        ends = np.cumsum(size)
        out_len, out_class = np.zeros(len(flat), np.int64), np.full(len(flat), -1, np.int64)
        self._run(flat, np.arange(len(size)), ends - size, ends, ends, out_len, out_class)
        return [(out_len[e - n : e], out_class[e - n : e]) for e, n in zip(ends, size, strict=True)]

    def _run(self, flat, ids, begin, at, ends, out_len, out_class) -> None:
        whole = len(self.text)
        lo, hi = np.zeros(len(ids), np.int64), np.full(len(ids), whole, np.int64)
        depth, known = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        state = [lo, hi, depth, known, at.copy(), begin.copy(), ends.copy()]
        while True:
            live = state[4] > state[5]
            lo, hi, depth, known, at, begin, ends = state = [x[live] for x in state]
            if not len(at):
                return
            at -= 1
            word = flat[at]
            a, b = self.wavelet.rank(word, lo, hi)
            a, b = self.before[word] + a, self.before[word] + b
            found = known & (b > a) & (word > 0)
            lo[found], hi[found], depth[found] = a[found], b[found], depth[found] + 1
            none = word == 0  # no match runs over an unknown word
            lo[none], hi[none], depth[none], known[none], ends[none] = 0, whole, 0, True, at[none]
            if len(k := np.flatnonzero(~found & ~none)):
                lo[k], hi[k], depth[k] = self._window(flat, at[k], ends[k])
                known[k] = depth[k] > 0
            out_len[at] = depth
            deep = depth >= self.window
            out_class[at[deep]] = self.group[lo[deep]]

    def _window(self, flat: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of the longest matches of at most ``window`` words from each place: whole ones, or none."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.text), np.int64)
        stop = np.minimum(at + self.window, ends)
        best = np.zeros(len(at), np.int64)
        pos = stop.copy()
        alive = stop - at >= 1
        while True:
            k = np.flatnonzero(alive & (pos > at))
            if not len(k):
                break
            pos[k] -= 1
            word = flat[pos[k]]
            a, b = self.wavelet.rank(word, lo[k], hi[k])
            a, b = self.before[word] + a, self.before[word] + b
            good = (b > a) & (word > 0)
            alive[k[~good]] = False
            lo[k], hi[k] = a, b
        lo[~alive], hi[~alive] = 0, len(self.text)
        best[alive] = (stop - at)[alive]
        return lo, hi, best
