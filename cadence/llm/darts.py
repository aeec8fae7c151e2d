"""DartMinHash signatures of weighted sets, vectorised over many sets.

An element of weight x owns the region [0, x) of a weight axis. Darts fall on weight x rank as a
Poisson process that depends on the element alone; each dart names one of `t` coordinates, and
the earliest dart (least rank) inside the regions is a coordinate's sample. Two sets agree on a
coordinate with probability sum(min) / sum(max), their weighted Jaccard similarity.

Only ranks up to about t (ln t + 2) darts' worth are looked at, so a set of W units costs
O(W + t log t) and not O(W t); sets with a coordinate still empty look twice as far.
"""

from __future__ import annotations

import math

import numpy as np

from . import spans

U = np.uint64
_STEP = U(0xD1342543DE82EF95)
NONE = np.iinfo(U).max


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def unit_cells(keys: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut regions into cells of one weight unit: key, owner and how much of the cell counts."""
    cells = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(keys)), cells)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    return spans.mix(keys[at] ^ spans.mix(nth.astype(U))), owner[at], np.minimum(1.0, weight[at] - nth)


def signatures(keys: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t samples; a row of NONE for a set without weight. keys: element hashes; owner: set of each."""
    cell, own, share = unit_cells(keys, owner, weight)
    total = np.bincount(own, share, minlength=n)
    out = np.full((n, t), NONE, U)
    reach = t * (math.log(t) + 2) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        pick = todo[own]
        out[todo] = NONE
        _throw(cell[pick], own[pick], share[pick], reach, out, t)
        todo = todo & (out == NONE).any(axis=1)
        reach[todo] *= 2
    return out


def _throw(cell: np.ndarray, own: np.ndarray, share: np.ndarray, reach: np.ndarray, out: np.ndarray, t: int) -> None:
    """The darts of each cell in order of rank, until they pass the set's reach."""
    flat = out.reshape(-1)
    rank = np.zeros(len(cell))
    nth = 0
    whole = bool((share >= 1.0).all())
    while len(cell):
        nth += 1
        h = spans.mix(cell + U((int(_STEP) * nth) & 0xFFFFFFFFFFFFFFFF))
        rank = rank - np.log(_uniform(h))
        ok = rank < reach[own]
        cell, own, share, rank, h = cell[ok], own[ok], share[ok], rank[ok], h[ok]
        g = spans.mix(h)
        sample = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (g >> U(32))
        slot = own * t + ((g & U(0xFFFFFFFF)) % U(t)).astype(np.int64)
        if not whole:  # only darts inside the region count
            inside = _uniform(spans.mix(g ^ _STEP)) <= share
            slot, sample = slot[inside], sample[inside]
        np.minimum.at(flat, slot, sample)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands: one hash of each band's `rows` samples."""
    n = len(signature)
    part = signature[:, : bands * rows].reshape(n, bands, rows)
    h = np.broadcast_to(spans.mix(np.arange(bands, dtype=U)), (n, bands)).copy()
    for k in range(rows):
        h = spans.mix(h ^ part[:, :, k])
    return h
