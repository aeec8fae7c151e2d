"""Fuzzy search for short licence notices.

A notice of m characters that may hold k edits is split into k + 1 pieces; by the pigeonhole
principle one piece stands unchanged in every match. All pieces form one Aho-Corasick automaton
that runs over the normalised text. A hit says where the notice would begin, give or take k, so
its window has a bounded length; windows that lack more than k of the notice's characters can't
hold a match and go. In the others the `regex` library's bounded-error matching (`{e<=k}`)
verifies the notice and reports its span and number of edits; equal windows of a text are
verified once. Of overlapping matches of a label the one with fewest edits stands.

Scale: map-only, one pass, no shuffle; the work is linear in a text's length, however often it
repeats a piece or a notice, and memory is that of one slice of texts.

Defined results: null text has no words and no notice (score 0, labels empty); a null doc_id keeps
its row; very long texts are read whole; a notice that overlaps another of its label counts once
for the label, of equal edits the earlier one; edits are counted in UTF-8 bytes, so a character
beyond ASCII counts for each of its bytes; repeated rows are answered alike; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, texts_of, tidy

# fixed values: the exact phrases and their labels
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# notices that may hold errors: text, label, edits
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("apache license", "apache", 1),
    ("licensed under the apache license version 2 0", "apache", 5),
    ("mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 8),
    ("creative commons attribution", "cc-by", 3),
    ("mozilla public license", "mpl", 2),
    ("all rights reserved", "all-rights-reserved", 2),
)

_NORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: bytes) -> tuple[bytes, int]:
    """Lower-cased words joined by one space, with a space at either end, and their number."""
    found = text.translate(_NORM).split()
    return b" " + b" ".join(found) + b" ", len(found)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """k + 1 parts of the notice with their offsets, of about equal length."""
    cut = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


@lru_cache(maxsize=4)
def _matcher(notices: tuple[tuple[str, str, int], ...]):
    import ahocorasick
    import regex

    at: dict[str, list[tuple[int, int]]] = {}
    for n, (notice, _, edits) in enumerate(notices):
        for offset, piece in pieces(notice, edits):
            at.setdefault(piece, []).append((n, offset))
    automaton = ahocorasick.Automaton()
    for piece, where in at.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    checks = [regex.compile(rf"(?b) (?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?= )") for notice, _, edits in notices]
    return automaton, checks


def _likely(text: np.ndarray, begins: np.ndarray, notice: str, edits: int) -> np.ndarray:
    """The begins whose windows lack at most `edits` of the notice's characters."""
    size = len(notice) + 2 * edits + 3
    wanted = {ord(c): notice.count(c) for c in set(notice)}
    out = []
    for at in range(0, len(begins), 4096):
        some = begins[at : at + 4096]
        window = text[(some - edits - 1)[:, None] + np.arange(size)]
        lacking = np.zeros(len(some), np.int64)
        for c, n in wanted.items():
            lacking += np.maximum(n - (window == c).sum(axis=1), 0)
        out.append(some[lacking <= edits])
    return np.concatenate(out) if out else begins


def fuzzy(norm: bytes, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of each notice found; byte offsets in the normalised text."""
    automaton, checks = _matcher(notices)
    text = norm.decode("latin-1")
    begins: dict[int, set[int]] = {}
    for end, (size, where) in automaton.iter(text):
        for n, offset in where:
            begins.setdefault(n, set()).add(end - size + 1 - offset)
    if not begins:
        return []
    margin = max(len(x[0]) + 2 * x[2] + 3 for x in notices)
    edge = np.zeros(margin, np.uint8)
    padded = np.concatenate([edge, np.frombuffer(norm, np.uint8), edge])
    matches: dict[str, set[tuple[int, int, int]]] = {}
    for n, places in begins.items():
        notice, label, edits = notices[n]
        known: dict[str, tuple[int, int, int] | None] = {}
        likely = _likely(padded, np.sort(np.fromiter((p for p in places if p > -margin // 2), np.int64)) + margin, notice, edits) - margin
        for begin in likely.tolist():
            lo = max(0, begin - edits - 1)
            window = text[lo : begin + len(notice) + edits + 2]
            if window not in known:
                m = checks[n].search(window)
                known[window] = (m.start() + 1, m.end(), sum(m.fuzzy_counts)) if m else None
            hit = known[window]
            if hit is not None:
                matches.setdefault(label, set()).add((hit[2], lo + hit[0], lo + hit[1]))
    found = []
    for label, hits in matches.items():
        taken = bytearray(len(norm))
        for edits, start, end in sorted(hits):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                found.append((label, start, end, edits))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan(text: bytes) -> dict:
    """All base places and fuzzy notices of one text."""
    norm, n_words = normalise(text)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)  # the k-th word stands behind the k-th
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in PHRASES:
        needle = b" " + phrase.encode() + b" "
        at = norm.find(needle)
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = norm.find(needle, at + 1)
    spans = fuzzy(norm)
    labels = base | {s[0] for s in spans}
    best = max((1 - s[3] / (s[2] - s[1]) for s in spans if s[2] > s[1]), default=0.0)
    return {
        "n_words": n_words,
        "n_base": len(starts),
        "first_word": int(np.searchsorted(gaps, min(starts))) if starts else None,
        "last_word": int(np.searchsorted(gaps, max(starts))) if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 if base else max(0.0, best),
        "spans": [{"label": s[0], "first": int(np.searchsorted(gaps, s[1])) - 1, "last": int(np.searchsorted(gaps, s[2])) - 1, "edits": s[3]} for s in spans],
    }


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64())]))
_COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels, score and the word spans of all notices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = [scan(t) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([g[c] for g in got], kind) for c, kind in _COLUMNS.items())], ["doc_id", *_COLUMNS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(run),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first:long,last:long,edits:long>>",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
