"""FM-index over sequences of word ids, in numpy.

The text is a sequence of phrases (runs of ids 1..vocabulary), each ended by a
separator 0. Separators are taken as distinct and smaller than every id, so no
match crosses one. Ranks over the transformed text come from a wavelet matrix;
occurrences are located by walking back to the nearest sampled position.
All searches are vectorised over many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` by prefix doubling from three symbols on."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    ends = text == 0
    separators = int(ends.sum())
    rank = text.astype(np.int64) + separators
    rank[ends] = np.arange(separators)
    base = int(rank.max()) + 2

    def ahead(r: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if step < n:
            out[: n - step] = r[step:] + 1
        return out

    if base < 1 << 20:
        key, step = (rank * base + ahead(rank, 1)) * base + ahead(rank, 2), 3
    else:
        key, step = rank * base + ahead(rank, 1), 2
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[0, (ordered[1:] != ordered[:-1]).astype(np.int64)])
        if fresh.max() == n - 1 or step >= n:
            return order
        rank = fresh
        key = rank * (n + 1) + ahead(rank, step)
        step *= 2


class WaveletMatrix:
    """Rank and access over a sequence of small integers, by bit planes."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = values
        for level in range(bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            prefix = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=prefix[1:])
            self.ones.append(prefix)
            self.zeros.append(self.n - int(prefix[-1]))
            current = np.concatenate([current[~bit], current[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(upto), upto
        for plane, level in enumerate(range(self.bits - 1, -1, -1)):
            prefix, zeros = self.ones[plane], self.zeros[plane]
            one = ((symbol >> level) & 1).astype(bool)
            l1, h1 = prefix[low], prefix[high]
            low = np.where(one, zeros + l1, low - l1)
            high = np.where(one, zeros + h1, high - h1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for plane in range(self.bits):
            prefix, zeros = self.ones[plane], self.zeros[plane]
            before = prefix[at]
            one = (prefix[at + 1] - before).astype(bool)
            out = (out << 1) | one
            at = np.where(one, zeros + before, at - before)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, vocabulary: int, sample: int = 8):
        """``text``: ids 1..vocabulary, phrases ended by 0."""
        text = np.asarray(text, np.int64)
        order = suffix_order(text)
        last = text[order - 1] if len(text) else text
        self.n = len(text)
        self.wavelet = WaveletMatrix(last, max(1, int(vocabulary).bit_length()))
        self.first = np.zeros(vocabulary + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=vocabulary + 1), out=self.first[1:])
        # sampled: every sample-th position and each start of a phrase, so a walk never crosses a separator
        position = np.arange(self.n)
        opens = np.r_[True, text[:-1] == 0] if self.n else np.zeros(0, bool)
        kept = (position % sample == 0) | opens
        self.sampled = kept[order]
        self.rows = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of equally long patterns (one per row), by backward search."""
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, k]
            low = self.first[c] + self.wavelet.rank(c, low)
            high = self.first[c] + self.wavelet.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        row = row.copy()
        steps = np.zeros(len(row), np.int64)
        walking = np.flatnonzero(~self.sampled[row]) if len(row) else np.zeros(0, np.int64)
        while len(walking):
            at = row[walking]
            c = self.wavelet.access(at)
            at = self.first[c] + self.wavelet.rank(c, at)
            row[walking] = at
            steps[walking] += 1
            walking = walking[~self.sampled[at]]
        return self.positions[self.rows[row]] + steps

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, text position) of every occurrence of every pattern."""
        if not self.n or not len(patterns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.search(patterns)
        count = high - low
        pattern = np.repeat(np.arange(len(patterns)), count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return pattern, self.locate(row)
