"""Odd rows through the pipeline's stages: clashing names, repeated ids, null ids, an empty table."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, kept boolean, host_rate double, _group int, _row long, size int, taken int, n_words int, base_failed boolean, carried string"
EXTRA = ("h", False, 0.5, 3, 4, 5, 6, 7, True, "c")


def rows():
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    out = [(k, say(60), "en", f"s{k % 3}") for k in range(12)]
    out += [(3, say(70), "en", "s1"), (3, out[3][1], "en", "s0"), (None, say(50), "en", None), (None, out[2][1], "en", "s2"), (20, out[5][1], "en", "s9"), (21, None, None, None)]
    return [(*r, len(r[1] or ""), *EXTRA) for r in out]


@pytest.mark.parametrize("stage", range(4))
def test_clashing_names_pass_through(spark, stage):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = corpus_pipeline.STAGES[stage][1](spark, df, "")
    assert got.columns == df.columns and got.dtypes == df.dtypes
    out = got.collect()
    assert out and all(tuple(r[5:]) == EXTRA for r in out)
    assert not corpus_pipeline.STAGES[stage][1](spark, df.limit(0), "").collect()


def test_repeated_ids_with_unlike_texts_stay(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    want = sorted({(str(r[0]), r[1] or "") for r in rows() if r[0] not in (20,)})
    assert got == want
