"""op4 and op6 against plain versions of themselves, and the SQL twin of op6."""

import os
import random

import duckdb

from cadence.llm import licenses, oracles, quality

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_licenses_against_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "no notice here", "MIT  License, and cc by", "Apache License " * 3, "x " * 3000 + "mit license"]
    for k in range(60):
        notice, _, most = rng.choice([n for n in licenses.NOTICES if len(n[0]) < 40])
        said = list(notice)
        for _ in range(rng.randrange(most + 3)):
            p = rng.randrange(1, len(said) - 1)
            said[p : p + 1] = rng.choice(([], ["q"], [said[p], "z"]))
        texts.append(f"foo {''.join(said)} bar")
    rows = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        norm, n = licenses.normalise((text or "").encode())
        words = norm.decode().split()
        base = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (rows[k].n_words, rows[k].n_base) == (len(words), len(base))
        assert rows[k].base_labels == ",".join(sorted({b[1] for b in base}))
        assert (rows[k].first_word, rows[k].last_word) == (min((b[0] for b in base), default=None), max((b[0] for b in base), default=None))
        if len(words) < 100:
            parts = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
            want = {label for notice, label, most in licenses.NOTICES if any(abs(len(p) - len(notice)) <= most and edits(p, notice) <= most for p in parts)}
            assert rows[k].labels == ",".join(sorted(want | {b[1] for b in base})), text


def test_an_untrusted_host_loses_what_the_house_rules_fail(spark):
    clean = " ".join(f"word{k}" for k in range(30))
    odd = clean + "".join(f" #{k}" for k in range(20))
    rows = [(k, odd, "bad") for k in range(40)] + [(100, clean, "bad")] + [(200 + k, clean, "good") for k in range(40)] + [(300, odd, "good")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {d: not (h == "bad" and t == odd) for d, t, h in rows}


def test_quality_equals_its_sql_twin(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(SF, 'documents.parquet')}')")
    df = quality.op6_quality(spark, SF)
    result = duck.execute(oracles.QUALITY)
    names = [d[0] for d in result.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, result.fetchall()))
