import hashlib
import random
import re

import numpy as np
import pytest

from cadence.llm import passages, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words int"


def corpus():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(300)] + ["é", "naïve", "x\x00y"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, hot, copy = say(80), say(60), say(200)
    rows = [(k, say(rng.randrange(5, 120)), "en", "s", 0) for k in range(60)]
    rows += [(100 + k, f"{say(7 * k)}\n{passage}\t{say(20)}", "en", "s", 0) for k in range(4)]
    rows += [(200 + k, f"{say(3)} {hot} {say(3)}", "en", "s", 0) for k in range(30)]
    rows += [(300 + k, copy, "en", "s", 0) for k in range(5)]
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, " \n ", None, None, 0), (None, copy, "en", "s", 0)]
    rows += [(5, passage, "en", "s", 0), (5, passage + " " + passage, "en", "s", 0), (500, "a " * 400, "en", "s", 0), (501, "a " * 130, "en", "s", 0), (502, "b" * 300, "en", "s", 0), (503, "b" * 80, "en", "s", 0)]
    edited = copy.split()
    edited[90] = "changed"
    rows += [(299, " ".join(edited), "en", "s", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4)


def brute(rows, split, window):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            u = split(text or "")
            for k in range(len(u) - window + 1):
                w = u[k : k + window]
                first[w] = min(first.get(w, doc_id), doc_id)
    for doc_id, text, *_ in rows:
        u = split(text or "")
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if doc_id is not None and first[u[k : k + window]] < doc_id:
                gone[k : k + window] = [True] * window
        yield doc_id, u, gone


def test_passages_equal_brute_force(docs):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in passages.remove_passages(docs).collect())
    want = sorted((str(d), len(u), sum(g), " ".join(w for w, x in zip(u, g, strict=True) if not x)) for d, u, g in brute(corpus(), lambda t: tuple(WORD.findall(t)), 50))
    assert got == want
    assert sum(w[2] for w in want) > 2000


@pytest.mark.parametrize("batch", [100, 500_000])
def test_strings_equal_brute_force(docs, batch):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix.remove_strings(docs, batch_bytes=batch).collect())
    want = []
    for d, u, g in brute(corpus(), lambda t: t.encode(), 50):
        spans = sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g))
        want.append((str(d), len(u), sum(g), spans, bytes(b for b, x in zip(u, g, strict=True) if not x)))
    assert got == sorted(want)
    assert hashlib.sha256(b"").hexdigest()  # kept_bytes of a whole copy is empty
    assert any(w[1] and w[1] == w[2] for w in want)


def test_levels_merge_geometrically():
    family, rng = suffix.Family(), random.Random(1)
    seen: dict[bytes, int] = {}
    for doc in range(200):
        text = bytes(rng.choice(b"ab") for _ in range(70)) if doc % 3 else bytes(rng.randrange(97, 123) for _ in range(70))
        data, starts = np.frombuffer(text, np.uint8), np.arange(70 - 8 + 1)
        level, place = suffix.Level.of(data, starts, np.full(len(starts), doc), 8)
        low = family.scan(level)[place]
        assert low.tolist() == [seen.setdefault(text[k : k + 8], doc) for k in range(len(starts))]
        family.add(level)
        for x in family.levels:
            words = x.strings(0, len(x)).tolist()
            assert words == sorted(set(words))
    sizes = [len(x) for x in family.levels]
    assert len(sizes) <= 8 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert sum(sizes) <= sum(len(x.data) for x in family.levels)


def test_blocks_of_two_arrays_walk_in_step():
    rng = random.Random(2)
    levels = []
    for doc in (0, 1):
        text = bytes(rng.choice(b"abc") for _ in range(3000))
        levels.append(suffix.Level.of(np.frombuffer(text, np.uint8), np.arange(2993), np.full(2993, doc), 8)[0])
    whole = sorted([*levels[0].strings(0, len(levels[0])).tolist(), *levels[1].strings(0, len(levels[1])).tolist()])
    for block in (1, 7, 10_000):
        got = [levels[int(b)].strings(int(k), int(k) + 1)[0] for in_b, at, _ in suffix.in_step(*levels, block=block) for b, k in zip(in_b, at, strict=True)]
        assert got == whole
    assert len(suffix.merged(*levels)) == len(set(whole))


def test_equal_hashes_of_unlike_words_stay_apart():
    data = np.frombuffer(b"ab cd ab ef ", np.uint8)
    w = passages.spans.words(passages.spans.join([b"ab cd ab ef"]))
    w.hash[:] = 7
    ids = passages.word_ids(data, w.start, w.end, w.hash)
    assert ids[0] == ids[2] and len(set(ids.tolist())) == 3


def test_clashing_names_and_rows_without_id(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    passage = say(70)
    rows = [(None, passage, 1, "a", "x", 5), (3, f"{say(9)} {passage}", 2, "b", "y", 6), (7, f"{passage} {say(4)}", 3, "c", "z", 7), (None, None, 4, None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _group int, carried string, `odd.name` string, n_removed int")
    for got in (passages.remove_passages(df), suffix.remove_strings(df)):
        assert got.columns[:5] == ["doc_id", "text", "_group", "carried", "odd.name"]
        by = {r._group: r for r in got.collect()}
        assert by[1].n_removed == by[2].n_removed == by[4].n_removed == 0 and by[3].n_removed >= 70 and by[4].carried is None


def test_texts_above_the_slice_limit(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, long = say(60), say(140_000)  # some 800 kB
    rows = [(1, f"{long} {passage} {say(10)}"), (2, f"{say(10)} {passage}"), (3, f"{say(120_000)} {passage} {long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in passages.remove_passages(df).collect()}
    assert got == {1: 0, 2: 60, 3: 140_060} or (got[1], got[2]) == (0, 60) and got[3] >= 140_060
    want = {r[0]: len(r[1]) for r in rows}
    out = {r.doc_id: r for r in suffix.remove_strings(df).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed >= len(passage) and out[3].n_removed >= len(long) + len(passage)
    assert all(out[k].n_bytes == want[k] for k in want)


def test_no_rows(docs):
    assert passages.remove_passages(docs.where("doc_id = -1")).count() == 0
    assert suffix.remove_strings(docs.where("doc_id = 401")).collect()[0].n_bytes == 0


def test_places_come_from_the_automaton_alone(spark):
    shared = [f"s{k}" for k in range(60)]
    docs = [(k, " ".join([f"a{k}x{n}" for n in range(40)] + shared + [f"b{k}x{n}" for n in range(40)])) for k in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    gone = lambda **how: {r.doc_id: r.n_removed for r in passages.remove_passages(df, **how).collect()}
    assert gone() == {0: 0, 1: 60, 2: 60, 3: 60}

    def without(phrases, gram):
        from cadence.llm import passages

        return passages.automaton_of([], gram)

    assert gone(build=without) == {0: 0, 1: 0, 2: 0, 3: 0}

    def astray(phrases, gram):
        """The automaton of other phrases finds other places."""
        from cadence.llm import passages

        return passages.automaton_of([b" ".join(reversed(p.split())) + b" " for p in phrases], gram)

    assert gone(build=astray) == {0: 0, 1: 0, 2: 0, 3: 0}


def test_a_phrase_repeated_in_later_documents_is_met(spark):
    """Of each group only the first and the last document of an anchor are sent."""
    text = " ".join(f"t{k}" for k in range(70))
    docs = [(3 * k, f"x{k} {text} y{k}") for k in range(5)] + [(3, f"z {text} {text} z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for remove, unit in ((passages.remove_passages, "n_removed"), (suffix.remove_strings, "n_removed")):
        got = {}
        for r in remove(df).collect():
            got[r.doc_id] = min(r[unit], got.get(r.doc_id, 10**9))
        assert got[0] == 0 and all(n > 60 for d, n in got.items() if d)
