import time

import pytest

from cadence.llm import licenses


@pytest.mark.parametrize(
    ("text", "edits"),
    [
        (" xx all rihts resrved foo all rights reserved bar all rigts reserved zz ", [2, 0, 1]),
        (" all rihts reserved all rights reserved ", [1, 0]),
        (" all rights reserved all rihts reserved ", [0, 1]),
        (" all rights reserved ", [0]),
    ],
)
def test_every_notice_of_a_window_is_reported(text, edits):
    assert [s[3] for s in licenses.fuzzy(text.encode()) if s[0] == "all-rights-reserved"] == edits


@pytest.mark.parametrize("piece", ["in source and binary ", "all rigts reserved ", "mit lcense ", "cc by ", "permission is hereby granted free of "])
def test_the_work_is_linear_in_a_text(piece):
    long = (piece * 20_000)[:200_000].encode()
    began = time.process_time()
    licenses.scan(long)
    assert time.process_time() - began < 1


def test_one_span_a_place():
    spans = licenses.scan(b"Licensed under the Apache License, Version 2.0; mit licens mit license")["spans"]
    assert [(s["label"], s["first"], s["last"], s["edits"]) for s in spans] == [("apache", 0, 7, 0), ("mit", 8, 9, 1), ("mit", 10, 11, 0)]


def test_nulls_long_texts_clashing_names_and_no_rows(spark):
    far = "plain words " * 60_000 + "redistribution and use in sourc and binary forms with or without modification"
    rows = [(None, "MIT license"), (1, None), (1, None), (2, ""), (3, far), (4, "mit license mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_documents(df.selectExpr("*", "1 AS spans", "2 AS labels", "3 AS score")).collect()}
    assert got[None, 2].labels == "mit" and got[1, 0].labels == "" and got[1, 0].score == 0 and got[1, 0].first_word is None
    assert got[3, 120_012].labels == "bsd" and got[3, 120_012].spans[0].first == 120_000
    assert (got[4, 4].n_base, got[4, 4].first_word, got[4, 4].last_word) == (2, 0, 2)
    assert licenses.scan_documents(df).count() == 6 and licenses.scan_documents(df.limit(0)).collect() == []
