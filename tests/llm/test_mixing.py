import re

import pytest

from cadence.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights, repeats=3):
    """Share out by weight, stop at the cap, share the excess again until none is above."""
    total, left = sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    room = float(total)
    while left:
        level = room / sum(weights[k] for k in left)
        full = {k for k in left if level * weights[k] >= repeats * sizes[k]}
        if not full:
            for k in left:
                target[k] = level * weights[k]
            break
        for k in full:
            target[k] = float(repeats * sizes[k])
            room -= target[k]
        left -= full
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k in range(600):
        source = [None, "b", "a", "c", "ä"][0 if k % 50 == 0 else 1 if k % 40 == 1 else 2 + k % 3]
        rows.append((k, "w " * (k % 90) if k % 7 else None, "en", source, 1))
    rows += [(5, "same row", "en", "a", 1)] * 3 + [(None, "x\ty\x0bz\n", "en", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_targets_and_taken(docs):
    rows = mixing.mix(docs, block_words=8).collect()
    assert len(rows) == docs.count()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size) for r in rows) == sorted((r.doc_id if r.doc_id is not None else -1, len(WORD.findall(r.text or ""))) for r in docs.collect())
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, water_fill([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 32)
    again = mixing.mix(docs.repartition(2), block_words=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_empty_and_wordless(spark, docs):
    assert mixing.mix(docs.where("doc_id = -1")).count() == 0
    rows = mixing.mix(docs.where("doc_id = 7")).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)]


def test_plan_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
