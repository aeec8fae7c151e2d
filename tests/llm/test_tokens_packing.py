import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cadence.llm import packing, token_files
from cadence.llm.tokens import Encoder, default_path

TEXTS = ["", None, " ", "  a b", "a  b ", "a \n b\n", "one two. three, four", " it's 3.5 don't. A.b .", "a <|endoftext|> b", "a\tb c\t d", "...!? ?? a.. b., c", "déjà vu  ß", "word " * 3000, "one two. three, four"]


def expected(text):
    library = Tokenizer.from_file(default_path())
    library.encode_special_tokens = True
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 1, "x") for k, t in enumerate(TEXTS)] + [(None, "no id", "en", "s", 1, "x"), (3, "  a b", "en", "s", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string").repartition(3)


def test_encoder_equals_library():
    enc = Encoder()
    for _ in range(2):
        got = enc.encode([t or "" for t in TEXTS])
        assert all((np.frombuffer(g, "<u4") == expected(t)[:-1]).all() for g, t in zip(got, TEXTS, strict=True))
    small = Encoder(keep=3)
    assert small.encode([t or "" for t in TEXTS]) == got


def test_token_files_round_trip(spark, docs):
    dictionary = token_files.sample_dictionary(docs)
    rows = token_files.read_tokens(token_files.write_tokens(docs, dictionary, segment_bytes=100), dictionary).collect()
    assert len(rows) == docs.count()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = expected("no id" if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == [None, *sorted(x for x in ordered if x is not None)]


def test_segment_reads_one_document_and_checks_the_dictionary():
    ids = [expected(t).tobytes() for t in TEXTS]
    raw = token_files.train_dictionary([x for x in ids])
    out = token_files.SegmentWriter(raw, 4)
    for k, x in enumerate(ids):
        out.add(k, x)
    seg = token_files.Segment(out.image(), raw)
    assert seg.read(6).tobytes() == ids[6]
    with pytest.raises(ValueError):
        token_files.Segment(out.image(), raw + b"x")


def test_empty_table(spark, docs):
    none = docs.where("doc_id = -1")
    assert packing.pack(none).count() == 0
    dictionary = token_files.sample_dictionary(none)
    assert token_files.read_tokens(token_files.write_tokens(none, dictionary), dictionary).count() == 0


def test_packing_covers_every_id_once(docs):
    rows = packing.pack(docs).collect()
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[(r.doc_id, r.doc_tokens)].append(r)
        per_seq[r.sequence_id].append(r)
    for seq in per_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    for (doc_id, _), pieces in per_doc.items():
        ids = expected("no id" if doc_id is None else TEXTS[doc_id])
        copies = 2 if doc_id == 3 else 1
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)


def test_sum_of_squares_rule_matches_brute_force():
    rng = np.random.default_rng(5)
    packer = packing.Packer(16)
    for _ in range(300):
        size = int(rng.integers(1, 16))
        n = packer.count.copy()

        def total(level):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 16:
                m[level + size] += 1
            return (m[:16] ** 2).sum()

        options = [0, *(h for h in range(1, 17 - size) if n[h] > 0)]
        assert total(packer.best_level(size)) == min(map(total, options))
        packer.add(1, bytes(4 * size))
    packer.finish()
    assert all(sum(map(len, g)) == 16 for g in packer.done[:-4])
