"""All document queries over one table of odd rows: nulls, empty and very long texts, repeated rows, clashing names, no rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadence.llm.queries import QUERIES

ROWS = [
    (1, "plain words here and there " * 5, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "no id at all " * 4, "en", "b"), (None, None, None, None),
    (4, "copied line of some words for all to see " * 9, "de", "b"), (5, "copied line of some words for all to see " * 9, "de", "b"), (6, "the same row twice " * 6, "en", "a"), (6, "the same row twice " * 6, "en", "a"),
    (7, " ".join(f"word{k % 5000}x{k}" for k in range(120_000)), "en", "c"), (8, "\n \t ", "en", "c"), (9, "é" * 40 + " naïve 漢字", "fr", "c"),
]
LONG = ROWS[9][1]
EXTRA = "*, 1 AS n_words, 'x' AS kept, 2 AS score, 3 AS class_id, 4 AS size, 'y' AS labels, 5 AS start, 6 AS n_bytes, 7 AS n, 8 AS rank, 9 AS item, 10 AS key, 11 AS toxic"
NAMES = ["op1_near_duplicates", "op2_toxicity", "op3_token_files", "op4_licenses", "op5_passages", "op6_quality", "op7_packing", "op8_suffix_arrays", "op9_mixing", "op12_spelling_variants", "op13_source_divergence"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").selectExpr(*EXTRA.split(", "))
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/none/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    labels.limit(0).write.parquet(f"{path}/none/labels.parquet")
    return str(path)


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    by = {}
    for r in rows:
        if "doc_id" in r.__fields__:
            by.setdefault(r.doc_id, []).append(r)
    words = len(LONG.split())
    if name not in ("op7_packing", "op12_spelling_variants", "op13_source_divergence"):
        assert len(rows) == len(ROWS) and len(by[None]) == 2 and len(by[6]) == 2
    if name == "op1_near_duplicates":
        assert by[4][0].class_id == by[5][0].class_id == 4 and by[7][0].class_id == 7
    if name == "op2_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    if name == "op3_token_files":
        for doc_id, text in ((7, LONG), (2, None), (9, ROWS[11][1])):
            ids = ids_of(text)
            assert (by[doc_id][0].n_tokens, by[doc_id][0].ids_crc32) == (len(ids), crc(ids))
    if name in ("op4_licenses", "op6_quality", "op5_passages"):
        assert by[2][0].n_words == by[3][0].n_words == by[8][0].n_words == 0
    if name in ("op5_passages", "op6_quality"):
        assert by[7][0].n_words == words
    if name == "op5_passages":
        assert by[5][0].n_removed == 81 and by[4][0].n_removed == 0 and by[6][0].n_removed == 0
    if name == "op6_quality":
        assert by[2][0].base_failed and not by[2][0].kept
    if name == "op7_packing":
        for doc_id, text in ((7, LONG), (2, None)):
            ids, pieces = ids_of(text), sorted(by[doc_id], key=lambda r: r.start)
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()] and sum(r.length for r in pieces) == pieces[0].doc_tokens == len(ids)
            assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in pieces)
    if name == "op8_suffix_arrays":
        assert by[7][0].n_bytes == len(LONG) and by[5][0].n_removed == by[5][0].n_bytes
    if name == "op9_mixing":
        assert by[7][0].size == words and by[2][0].taken == 0
    if name == "op13_source_divergence":
        assert {(r.lang, r.source) for r in rows if r.part == "pair"} == {(x, y) for x, y in {("en", "a"), ("en", "b"), ("en", "c")}}


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, folder, name):
    assert QUERIES[name](spark, f"{folder}/none").collect() == []
