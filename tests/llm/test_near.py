import random
from collections import Counter

import numpy as np
import pytest

from cadence.llm import caps, darts, neardup, spans
from cadence.llm.components import components


def roots_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert got == roots_of(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = spans.mix(np.arange(800, dtype=np.uint64))
    a, b = rng.random(800) * 3, rng.random(800) * 3
    b[:400] = a[:400]
    s = darts.signatures(np.concatenate([keys, keys]), np.repeat([0, 1], 800), np.concatenate([a, b]), 3, 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert (s[:2] != darts.NONE).all() and (s[2] == darts.NONE).all()


def corpus():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(20, 90)))) for k in range(80)]

    def edit(text, n):
        words = text.split()
        for _ in range(n):
            words[rng.randrange(len(words))] = "new"
        return " ".join(words)

    for k in range(12):
        rows.append((100 + k, edit(rows[k][1] + " " + rows[k + 20][1], 0)))
        rows += [(200 + 10 * k + j, edit(rows[-1 - j][1], 1)) for j in range(4)]
    rows += [(900 + k, rows[3][1]) for k in range(5)]
    rows += [(950, "only three words"), (951, "only three words"), (952, "only  three\nwords"), (960, ""), (961, None), (962, " "), (963, ""), (None, rows[3][1]), (970, rows[5][1]), (970, rows[5][1])]
    rows += [(980, "again " * 50), (981, "again " * 45), (982, "again " * 20)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in corpus()], "doc_id long, text string, class_id int, bucket string").repartition(3)


def test_classes_equal_brute_force(docs):
    sets = {}
    for d, t in corpus():
        w = (t or "").split()
        if d is not None:
            sets[d] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    ids = sorted(sets)
    edges = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            low, high = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
            if low and low >= 0.8 * high:
                edges.append((a, b))
    want = roots_of(ids, edges)
    rows = neardup.classes(docs).collect()
    assert len(rows) == len(corpus())
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in rows)
    assert len(edges) > 60


def test_no_documents(docs):
    assert neardup.classes(docs.where("doc_id = -1")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(64)
        for _ in range(100 if c == 0 else 6):
            rows.append(list(map(float, (centre + rng.standard_normal(64) * [0.1, 0.2, 0.3, 0.35, 0.4, 0.5][c]).astype(np.float32))))
    rows += [list(map(float, rng.standard_normal(64).astype(np.float32))) for _ in range(200)]
    rows += [rows[0]] * 3 + [[x * 4 for x in rows[0]]]
    return [(k * 7 % 1009, r) for k, r in enumerate(rows)]


def test_vectors_against_brute_force(spark):
    good = vectors()
    odd = [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] + [1.0] * 63), (2004, [None] + [1.0] * 63), (2005, [float("inf")] * 64), (2006, [1e-30] * 64), (2007, [1e-40] * 64), (2008, [1.0, 2.0]), (2009, [2.0, 4.0]), (None, good[0][1])]
    frame = spark.createDataFrame([(a, b, 0, "x") for a, b in good + odd], "vec_id long, embedding array<float>, label int, key string").repartition(3)
    rows = {r.vec_id: r for r in caps.near_vectors(frame, block=40).collect()}
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [k for k, _ in good]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    true, got = int(near.sum()), sum(rows[k].n_links for k in ids)
    assert all(rows[k].n_links <= near[i].sum() for i, k in enumerate(ids))
    assert got >= 0.98 * true > 5000
    roots = roots_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert sum(rows[k].component_id != roots[k] for k in ids) <= 2
    assert [rows[k].n_links for k in range(2000, 2010)] == [0] * 6 + [1, 1, 1, 1]
    assert rows[2007].component_id == 2006 and rows[2009].component_id == 2008 and rows[2003].kept
    assert rows[None].n_links == 0 and rows[None].component_id is None and rows[None].kept
    assert len(rows) == len(good) + len(odd)
    assert caps.near_vectors(frame.where("vec_id = -1")).count() == 0
