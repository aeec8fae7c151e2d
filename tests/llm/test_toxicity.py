import itertools
import random

import numpy as np
import pytest

from cadence.llm import toxicity as tox


def brute_kernel(s, t):
    def subsequences(w):
        out = {}
        for places in itertools.combinations(range(len(w)), tox.ORDER):
            key = tuple(w[p] for p in places)
            out[key] = out.get(key, 0.0) + tox.DECAY ** (places[-1] - places[0] + 1)
        return out

    a, b = subsequences(s), subsequences(t)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_kernel_equals_definition():
    words = ["abcab", "xabxcx", "banana", "nab", "abc", "ccc", "ab"]
    codes = tox._codes(words)
    for i, s in enumerate(words):
        row = tox.subsequence_kernel(np.repeat(codes[i : i + 1], len(words), axis=0), codes, -1)
        assert np.allclose(row, [brute_kernel(s, t) for t in words], rtol=1e-4, atol=1e-6)


def test_cleaning():
    assert [tox.clean(w) for w in ("i.d.i.o.t", "id1ot", "st-upid,", "123", "naïve!")] == ["idiot", "idiot", "stupid", "", "naïve"]
    assert "idiot" in tox.tokens("you i d i o t there")
    assert all(len(p) <= tox.LONGEST for p in tox.parts("x" * 100)) and "".join(sorted(set("".join(tox.parts("abc" * 30))))) == "abc"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, labels = [], []
    for k in range(400):
        bad = k % 3 == 0
        docs.append((k, f"{say(20)}. {say(8)} {rng.choice(['dimwit', 'blockhead', 'knucklehead']) if bad else say(1)} {say(5)}. {say(9)}", "en", 0.5))
        labels.append((k, 1, int(bad)))
    docs += [(1000, "", "en", 0.5), (1001, None, None, None), (None, "dimwit", "en", 0.5), (1002, say(50) + " dim-wit, block.head " + say(4), "en", 0.5), (1003, say(3000), "en", 0.5), (3, docs[3][1], "en", 0.5)]
    labels += [(None, 1, 1), (2, 1, None), (0, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(tables):
    import zlib

    docs, labels = tables
    rows = tox.score(docs, tox.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) >= 0.95
    by = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert by[1000].score == by[1001].score < 0.5 and by[None].predicted == 1
    assert by[1002].predicted == 1 and by[1003].predicted == 0


def test_one_class_and_no_rows(tables):
    docs, labels = tables
    model = tox.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in tox.score(docs, model).collect()} == {0.0}
    assert tox.score(docs.where("doc_id = -1"), tox.fit(docs.where("doc_id = -1"), labels)).count() == 0
