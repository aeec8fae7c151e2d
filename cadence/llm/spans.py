"""Vectorised words, hashes and content-defined anchors of a batch of texts.

Everything works on one concatenated byte array per batch, so the cost per byte is a
few NumPy passes and no Python loop runs over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, dtype=U)
_UNPOW = np.ones(1, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _UNPOW
    if len(_POW) < n:
        size = max(n, 1 << 16)
        _POW = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, _BASE, U), dtype=U)])
        _UNPOW = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, _UNBASE, U), dtype=U)])
    return _POW, _UNPOW


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in a fixed odd base, modulo 2**64."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], dtype=U, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the run stands."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


@dataclass
class Joined:
    """Texts joined by one space each. `start[d]:end[d]` are the bytes of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def join(texts: list[bytes]) -> Joined:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(sizes + 1) - 1
    return Joined(np.frombuffer(b" ".join(texts) + b" ", np.uint8), end - sizes, end)


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+`: byte range, text and hash of each; `first[d]:first[d+1]` are text d's."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(j: Joined) -> Words:
    space = _SPACE[j.data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(j.data) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the join ends in a space, so edges pair up
    first = np.searchsorted(start, np.concatenate([j.start, [len(j.data)]]))
    doc = np.repeat(np.arange(len(j.start)), np.diff(first))
    prefix = prefix_hash(_BYTE[j.data])
    return Words(start, end, doc, first, range_hash(prefix, start, end))


def single_spaced(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each starts there (with the closing end)."""
    keep = ~_SPACE[data]
    keep[w.end] = True  # the space behind a word; a join ends in one
    plain = data.copy()
    plain[w.end] = 0x20
    size = w.end - w.start + 1
    return plain[keep], np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    prefix = prefix_hash(values)
    at = np.arange(n)
    return range_hash(prefix, at, at + k)


def leftmost_min(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest value of each w-window."""
    low, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < w:
        step = min(have, w - have)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[:-step], low[step:])
        have += step
    return at


@dataclass
class Runs:
    """Consecutive windows `lo..hi` (starts, inclusive) of text `doc` that share the anchor at `at`."""

    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    key: np.ndarray


def anchor_runs(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> Runs:
    """Split all windows of `window` values inside a text into runs with one anchor each.

    The anchor is the window's leftmost gram of least hash, so equal windows have equal
    anchors wherever they stand; every window belongs to exactly one run.
    """
    none = np.zeros(0, np.int64)
    n = len(values)
    if n < window:
        return Runs(none, none, none, none, np.zeros(0, U))
    g = grams(values, gram)
    at = leftmost_min((g >> U(32)).astype(np.uint32), window - gram + 1)[: n - window + 1]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = doc[: n - window + 1] == doc[window - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1] | (doc[1 : len(at)] != doc[: len(at) - 1])
    lo = np.flatnonzero(new & ok)
    stop = np.flatnonzero(np.append((new | ~ok)[1:], True))
    hi = stop[np.searchsorted(stop, lo)]
    p = at[lo].astype(np.int64)
    return Runs(doc[lo], lo, hi, p, g[p])
