"""Recall of the cap filters just above the threshold, as large tables have them."""

import inspect
import math

import numpy as np
import pytest

from cadence.llm import caps


def pairs(cosine, concentrated, m=400, dim=64):
    rng = np.random.default_rng(17)
    a, e = rng.standard_normal((2, m, dim))
    if concentrated:  # nearly all of a vector in its first half
        a[:, dim // 2 :] *= 0.02
        e[:, dim // 2 :] *= 0.02
    a = caps.unit(a)
    e = caps.unit(e - (e * a).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * e


@pytest.mark.parametrize("n", [2_000, 100_000, 1_000_000])
@pytest.mark.parametrize("concentrated", [False, True])
def test_pairs_at_the_threshold_share_a_filter_at_any_size(n, concentrated):
    asked = {k: v.default for k, v in inspect.signature(caps.near_vectors).parameters.items()}
    q = caps.filters_across(n)
    size = caps.width(64, q, asked["threshold"], asked["recall"], asked["per_vector"], asked["least"])
    for cosine, least in ((0.9, 0.97), (0.92, 0.98)):
        found = []
        for x in pairs(cosine, concentrated):
            found.append([codes for lo in range(0, len(x), 100) for codes in caps.decode(x[lo : lo + 100], q, *size)])
        assert np.mean([bool(np.intersect1d(f, g).size) for f, g in zip(*found, strict=True)]) >= least


def test_few_dimensions_and_single_ones():
    for dim in (1, 2, 3, 300):
        x = caps.unit(np.random.default_rng(dim).standard_normal((5, dim)))
        assert np.allclose(np.linalg.norm(caps.rotated(x), axis=1), 1)
        assert all(len(f) for f in caps.decode(x, 100, *caps.width(dim, 100, 0.9, 0.99, 24, 16)))
