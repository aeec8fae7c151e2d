"""Spelling variants against a plain version that compares every pair of words."""

import random
import re
from collections import Counter
from zlib import crc32

from cadence.llm import variants
from cadence.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
            h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(u, w):
        if len(u) == len(w):
            return sum(a != b for a, b in zip(u, w)) == 1
        if len(u) > len(w):
            u, w = w, u
        return len(w) - len(u) == 1 and any(w[:k] + w[k + 1 :] == u for k in range(len(w)))

    form, out = {}, []
    by_len = {}
    for w in words:
        by_len.setdefault(len(w), []).append(w)
    mates = {w: [u for k in (-1, 0, 1) for u in by_len.get(len(w) + k, ()) if near(u, w)] for w in words}
    for w, n in words.items():
        best = min(mates[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(mates[w]), words.get(form[w])))
    return sorted(out)


def answer(spark, docs, **how):
    rows = variants.spelling_variants(spark.createDataFrame(docs, SCHEMA), **how).collect()
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows)


def made(seed, n=400):
    rng = random.Random(seed)
    stems = ["anagrams", "nagarams", "Spelling", "spellings", "élèvement", "aaaaaaaa", "aaaaaaab", "letters×x"]
    docs = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(30)):
            w = rng.choice(stems)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "z", "ab", w[at] * 2]) + w[at + 1 :]
            words.append(w)
        docs.append((k, rng.choice([" ", "-", "1"]).join(words)))
    return docs


def test_against_every_pair(spark):
    docs = made(1)
    want = plain(docs)
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)
    assert answer(spark, docs) == want
    # remainders of all words as prints
    assert answer(spark, docs, long_word=0) == want


def test_chains_of_forms_end_at_the_last(spark):
    # each ten times as often as the one before, one letter further away
    chain = ["chained", "chainee", "chainef", "chaxnef", "cyaxnef"]
    docs = [(k, " ".join([w] * (2 * 11**k))) for k, w in enumerate(chain)]
    want = plain(docs)
    assert {r[0]: r[2] for r in want}["chained"] == "cyaxnef"
    assert answer(spark, docs) == want


def test_nulls_empty_long_repeated_and_no_rows(spark):
    letters = "ab" * 4000
    docs = [(None, "nullids nullids"), (1, None), (2, ""), (3, "repeats"), (3, "repeats"), (4, f"{letters} {letters} {letters}c {letters}c"), (5, "x1y2 " * 300_000 + "distant distant"), (5, "ÀCCENTS àccents Àccents ÀCCENTS")]
    assert answer(spark, docs) == plain(docs)
    assert answer(spark, []) == []
    extra = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "3 AS form", "4 AS id")
    assert variants.spelling_variants(extra).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(variants.spelling_variants(extra).select("word", "n_near").collect()) == sorted((r[0], r[4]) for r in plain(docs))


def test_query_over_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == plain([tuple(r) for r in rows])
