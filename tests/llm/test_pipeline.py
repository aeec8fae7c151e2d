"""Each stage of the pipeline against a plain version of itself on a small corpus."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cadence.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(700)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(70)
    rows = [(k, say(rng.randrange(10, 200)), "en", f"s{k % 4}") for k in range(120)]
    rows += [(200 + k, rows[k][1] + " tail", "en", "s1") for k in range(0, 40, 4)]
    rows += [(300 + k, say(90) + "\n" + passage + " " + say(90), "en", "s2") for k in range(6)]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, "spam " * 300, "en", "s0"), (403, passage, "en", None), (404, say(60), "en", None), (405, rows[50][1], "en", "s3")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == COLUMNS
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "substring dedup", "mixing sources to target weights", "packing"]


def test_quality_rules(stages):
    def ok(text):
        w = WORD.findall(text or "")
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)

    assert sorted(stages[0]) == sorted(r for r in corpus() if ok(r[1]))


def test_near_duplicates(stages):
    rows = sorted(stages[0])
    sets = {}
    for r in rows:
        w = WORD.findall(r[1])
        sets[r[0]] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total():
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert sorted(stages[1]) == [r for r in rows if find(r[0]) == r[0]]
    assert len(stages[1]) < len(stages[0]) - 8


def test_passages(stages):
    first = {}
    rows = sorted(stages[1])
    for r in rows:
        w = WORD.findall(r[1])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), r[0])
    want = []
    for r in rows:
        w = WORD.findall(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < r[0]:
                gone[k : k + 50] = [True] * 50
        text = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else r[1]
        if text:
            want.append((r[0], text, r[2], r[3], len(text)))
    assert sorted(stages[2]) == want
    assert sum(r[1] != s[1] for r, s in zip(rows, want, strict=False)) >= 5


def test_mixing(stages):
    words = lambda rows: sum(len(WORD.findall(r[1])) for r in rows)
    before, after = defaultdict(list), defaultdict(list)
    for r in stages[2]:
        before[r[3]].append(r)
    for r in stages[3]:
        after[r[3]].append(r)
    assert set(stages[3]) <= set(stages[2]) and max(Counter(stages[3]).values()) <= 3
    names = sorted(x for x in before if x is not None) + [None] * (None in before)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    room, left, target = float(words(stages[2])), set(names), {}
    while left:
        level = room / sum(weight[n] for n in left)
        full = {n for n in left if level * weight[n] >= 3 * words(before[n])}
        for n in full or left:
            target[n] = 3.0 * words(before[n]) if full else level * weight[n]
        room -= sum(target[n] for n in full)
        left = left - full if full else set()
    longest = max(len(WORD.findall(r[1])) for r in stages[2])
    assert all(abs(words(after[n]) - target[n]) <= longest + 64 for n in names)


def test_packing(stages):
    enc = Encoder()
    want = Counter((r[0], np.frombuffer(x, "<u4").size + 1) for r, x in zip(stages[3], enc.encode([r[1] for r in stages[3]]), strict=True))
    tokens = {r[0]: np.append(np.frombuffer(x, "<u4"), 0).astype("<u4") for r, x in zip(stages[3], enc.encode([r[1] for r in stages[3]]), strict=True)}
    got, seqs = Counter(), defaultdict(int)
    for doc_id, start, length, crc, total, seq, _ in stages[4]:
        got[(doc_id, total)] += length
        seqs[seq] += length
        assert crc == zlib.crc32(tokens[doc_id][start : start + length].tobytes())
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    assert all(n == 1024 or n & (n - 1) == 0 for n in seqs.values())
