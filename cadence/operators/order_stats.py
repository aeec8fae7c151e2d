"""Order statistics over any stretch of a series, in log n steps each."""

from __future__ import annotations

import numpy as np


class Ranked:
    """A series' measured values as a wavelet matrix: one row of bits for each binary digit of the ranks.

    `kth` and `median` answer many stretches at once; building takes n log n, an answer log n."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.float64)
        there = ~np.isnan(values)
        self.before = np.append(0, np.cumsum(there))  # measured values before each sample
        x = values[there]
        order = np.argsort(x, kind="stable")
        self.sorted = x[order]
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(len(x) - 1, 0).bit_length() - 1, -1, -1):
            one = (rank >> bit & 1).astype(bool)
            zeros = np.append(0, np.cumsum(~one))
            self.levels.append((bit, zeros, int(zeros[-1])))
            rank = np.concatenate([rank[~one], rank[one]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the measured values lo..hi-1; k must lie within."""
        lo, hi, k = (np.array(x, np.int64) for x in (lo, hi, k))
        rank = np.zeros(len(k), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[lo], zeros[hi]
            up = k >= b - a
            rank |= up.astype(np.int64) << bit
            k = np.where(up, k - (b - a), k)
            lo = np.where(up, total + lo - a, a)
            hi = np.where(up, total + hi - b, b)
        return self.sorted[rank]

    def median(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The median of the measured values of samples first..end-1; NaN where none is."""
        lo, hi = self.before[first], self.before[end]
        n = hi - lo
        out = np.full(len(n), np.nan)
        some = np.flatnonzero(n > 0)
        if len(some):
            lo, hi, n = lo[some], hi[some], n[some]
            out[some] = (self.kth(lo, hi, (n - 1) // 2) + self.kth(lo, hi, n // 2)) / 2
        return out


class Least:
    """Where the least value of any stretch stands, in one step each, from tables of stretches of 2^k."""

    def __init__(self, values: np.ndarray, last: bool = False):
        """Of equal values the first, or the last, counts."""
        self.v, self.last = np.asarray(values, np.float64), last
        self.tables = [np.arange(len(self.v))]
        while 2 << (len(self.tables) - 1) <= len(self.v):
            step, above = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(self._better(above[:-step], above[step:]))

    def _better(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.v[b] <= self.v[a] if self.last else self.v[b] < self.v[a], b, a)

    def at(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of the least value of first..last, both included."""
        first, last = np.asarray(first, np.int64), np.asarray(last, np.int64)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            pick = level == k
            out[pick] = self._better(self.tables[k][first[pick]], self.tables[k][last[pick] + 1 - (1 << int(k))])
        return out


def next_higher(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the last higher one before it (or -1) and the first one behind it (or n), by a falling stack."""

    def before(values: list[float]) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        stack: list[int] = []
        for i, x in enumerate(values):
            while stack and values[stack[-1]] <= x:
                stack.pop()
            # what was popped was no higher, so it can hide nothing from later samples
            out[i] = stack[-1] if stack else -1
            stack.append(i)
        return out

    values = np.asarray(v, np.float64).tolist()
    return before(values), len(values) - 1 - before(values[::-1])[::-1]
