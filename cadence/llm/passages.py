"""Repeated-phrase automata: remove passages that an earlier document already holds.

Phrases of `gram` words (content-chosen, so that every window of `window` words holds one) that
stand in two documents are confirmed by meeting each other, by hash. The first document that has
one writes it out for every group of documents in which it stands. Each group compiles the
phrases it was sent into its Aho-Corasick automaton (pyahocorasick, over words), and all its
documents stream through it. The places that the automaton reports are the only ones that are
looked at: the windows around each go to the shard of its phrase, where those of all groups are
compared exactly, and a window met in a smaller doc_id is removed. Equal windows hold the same
phrases, so they meet.

Scale: see routing.py. Four shuffles: packed hashes, confirmed phrases, candidate stretches,
removed runs; the texts are dealt once and that exchange is used four times. Automata and shards
hold their own group's phrases and stretches only, and both stay level in size as the input grows.

Defined results: null text has no words; a document without an id is left whole and removes
nothing; rows that share a doc_id never remove each other's words; an empty table gives no
rows; extra columns pass through, but those named like a result give way to it; very long texts
are cut into windows like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import spans
from .common import carried, restored, sha, slices, staged, table, tidy
from .routing import CANDIDATE, REMOVED, Piece, Sizes, Stretches, Units, answers_and_copies, applied, as_candidates, copies, copies_of, coverage, filled, group_of, grouped, met, removed, sent, those, window_ranks

UNITS = Units(words=True)
U = np.uint64


def confirmed(dealt: DataFrame, same: DataFrame, units: Units, sizes: Sizes) -> DataFrame:
    """(group, phrases): the phrases that stand in two documents, for each group with such a document.

    Of a phrase's documents the one with the smallest id writes it out."""
    n_groups = sizes.groups

    def lead(rows: pa.Table) -> pa.Table:
        """(group, docs, keys, targets): to the group of the first document, a phrase and a group that needs it."""
        key, owner = met(rows)
        if not len(key):
            return pa.table({"_group": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("docs", "keys", "targets")}})
        start = np.append(True, key[1:] != key[:-1])
        first = np.minimum.reduceat(owner, np.flatnonzero(start))[np.cumsum(start) - 1]
        target = group_of(owner, n_groups)
        order = np.lexsort((target, key))
        key, first, target = key[order], first[order], target[order]
        once = np.append(True, (key[1:] != key[:-1]) | (target[1:] != target[:-1]))
        key, first, target = key[once], first[once], target[once]
        group = group_of(first, n_groups)
        order = np.argsort(group, kind="stable")
        key, first, target, group = key[order], first[order], target[order], group[order]
        cut = np.flatnonzero(np.diff(group)) + 1
        cuts = zip(*(np.split(x, cut) for x in (group, first, key, target)), strict=True)
        got = [(int(g[0]), f.astype("<i8").tobytes(), k.tobytes(), t.astype("<i4").tobytes()) for g, f, k, t in cuts]
        return pa.table({"_group": pa.array([g[0] for g in got], pa.int32()), **{c: pa.array([g[n] for g in got], pa.binary()) for n, c in enumerate(("docs", "keys", "targets"), 1)}})

    def write(docs: pa.Table, asked: pa.Table) -> pa.Table:
        blocks = filled(asked, "docs")
        rows: list[tuple[int, bytes]] = []
        if blocks and docs.num_rows:
            first = np.concatenate([np.frombuffer(x, "<i8") for x in blocks])
            key = np.concatenate([np.frombuffer(x, "<u8") for x in filled(asked, "keys")])
            target = np.concatenate([np.frombuffer(x, "<i4") for x in filled(asked, "targets")])
            wanted, leaders = np.unique(key), set(first.tolist())
            known, text = copies_of(asked), {}
            for batch in docs.select(["doc_id", "text"]).to_batches():
                mine = batch.filter(pa.array([d in leaders for d in batch.column("doc_id").to_pylist()], pa.bool_()))
                for part in slices(mine, "text", 600_000):
                    piece = Piece.of(part, known, units)
                    for k in those(piece, wanted).tolist():
                        at = int(piece.runs.at[k])
                        text[int(piece.runs.key[k] >> U(16))] = piece.data[piece.start[at] : piece.start[at + units.gram]].tobytes()
            order = np.argsort(target, kind="stable")
            cut = np.flatnonzero(np.diff(target[order])) + 1
            for pick in np.split(order, cut):
                phrases = [text[k] for k in key[pick].tolist() if k in text]
                if phrases:
                    rows.append((int(target[pick[0]]), b"\n".join(phrases)))
        return pa.table({"_group": pa.array([r[0] for r in rows], pa.int32()), "phrases": pa.array([r[1] for r in rows], pa.binary())})

    leading = sent(dealt, same, units, sizes).groupBy("part").applyInArrow(tidy(lead), "_group int, docs binary, keys binary, targets binary")
    right = answers_and_copies(leading, same, "docs", "keys", "targets")
    return dealt.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(tidy(write), "_group int, phrases binary")


def letters(hashes: np.ndarray) -> str:
    """Words as the automaton reads them: two letters each, of 256 by the word's hash, so that a node has few branches.

    Phrases of the same letters only add a place to compare."""
    return (hashes >> U(48)).astype("<u2").tobytes().decode("latin-1")


def automaton_of(phrases: list[bytes], gram: int):
    """The phrases' automaton, whose values are their numbers, and a hash of each."""
    import ahocorasick

    j = spans.join(phrases)
    w = spans.words(j)
    prefix = spans.prefix_hash(w.hash)
    keys = spans.range_hash(prefix, w.first[:-1], w.first[1:])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist(), strict=False)):
        if b - a == gram:
            automaton.add_word(letters(w.hash[a:b]), n)
    if len(automaton):
        automaton.make_automaton()
    return automaton, keys


def around(piece: Piece, automaton, units: Units) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, phrase number) of the windows around each place that the automaton reports."""
    none = np.zeros(0, np.int64)
    if not len(automaton) or not len(piece.values):
        return none, none, none, none
    hits = [(end // 2, n) for end, n in automaton.iter(letters(piece.values)) if end & 1]
    if not hits:
        return none, none, none, none
    last, number = np.array(hits, np.int64).T
    at = last - units.gram + 1
    doc = np.searchsorted(piece.first, at, "right") - 1
    lo = np.maximum(at - (units.window - units.gram), piece.first[doc])
    hi = np.minimum(at, piece.first[doc + 1] - units.window)
    inside = np.flatnonzero((lo <= hi) & (last < piece.first[doc + 1]))
    return doc[inside], lo[inside], hi[inside], number[inside]


def located(dealt: DataFrame, phrases: DataFrame, same: DataFrame, units: Units, sizes: Sizes, build: Callable = automaton_of) -> DataFrame:
    """The windows around all places of the confirmed phrases, as rows of CANDIDATE."""

    def emit(docs: pa.Table, answers: pa.Table) -> pa.Table:
        listed = [p for block in filled(answers, "phrases") for p in block.split(b"\n")]
        parts, keys, routes = [], [], []
        if listed and docs.num_rows:
            known = copies_of(answers)
            automaton, phrase_key = build(listed, units.gram)
            for batch in docs.select(["doc_id", "text"]).to_batches():
                for part in slices(batch, "text", 600_000):
                    piece = Piece.words(part, known)
                    doc, lo, hi, number = around(piece, automaton, units)
                    if len(doc):
                        got, body_key = piece.stretches(doc, lo, hi, units.window)
                        route = phrase_key[number] >> U(16)
                        parts.append(got)
                        keys.append(body_key ^ route)
                        routes.append(route)
        return as_candidates(parts, keys, routes, sizes)

    right = answers_and_copies(phrases, same, "phrases")
    return dealt.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(tidy(emit), CANDIDATE)


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A number for each word, the same where the words are equal byte for byte."""
    _, head, ids = np.unique(code, return_index=True, return_inverse=True)
    size = end - start
    like = head[ids]
    same = size == size[like]
    at = np.flatnonzero(same & (like != np.arange(len(like))))
    for k in range(0, len(at), 100_000):
        part = at[k : k + 100_000]
        n = size[part]
        index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unlike = data[index + np.repeat(start[part], n)] != data[index + np.repeat(start[like[part]], n)]
        same[part] = ~np.logical_or.reduceat(unlike, np.cumsum(n) - n)
    if not same.all():  # hashes of unlike words met
        raw, names = data.tobytes(), {}
        ids = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    return ids


def decide(shard: Stretches, window: int = UNITS.window) -> np.ndarray:
    """REMOVED records of one shard: windows whose word sequence a smaller doc_id holds."""
    if not len(shard):
        return np.zeros(0, REMOVED)
    found = []
    for a, b, at in shard.parts():  # each body ends in a space
        body = shard.body[at : at + int(shard.size[a:b].sum(dtype=np.int64))]
        w = spans.words(spans.Joined(body, np.zeros(1, np.int64), np.array([len(body)])))
        found.append((w.start + at, w.end + at, w.hash))
    start, end, code = (np.concatenate(x) for x in zip(*found, strict=True))
    win = shard.win.astype(np.int64)
    words = win + window - 1
    at = np.arange(int(win.sum())) + np.repeat(np.cumsum(words) - words - (np.cumsum(win) - win), win)
    docs, rank = np.repeat(shard.doc, win), window_ranks(word_ids(shard.body, start, end, code), window, at)
    low = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, rank, docs)
    return shard.removals(low[rank] < docs, window)


def cut_words(text: bytes, runs: np.ndarray | None, window: int = UNITS.window) -> tuple[int, int, str]:
    found = text.split()
    if runs is None or len(found) < window:
        return len(found), 0, b" ".join(found).decode()
    gone = coverage(runs, len(found))
    kept = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
    return len(found), len(found) - len(kept), b" ".join(kept).decode()


RESULTS = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string()}


def remove_passages(docs: DataFrame, units: Units = UNITS, build: Callable = automaton_of) -> DataFrame:
    """The documents with n_words, n_removed and kept_text (kept words joined by one space)."""
    sizes = Sizes.of(docs)
    wide = carried(docs, "doc_id", "text")
    dealt = grouped(wide, sizes)
    same = staged(copies(dealt), "copies")
    # the same dealt table four times: Spark shuffles it once
    rows = located(dealt, confirmed(dealt, same, units, sizes), same, units, sizes, build)
    runs = removed(rows, partial(decide, window=units.window), units, sizes)
    out = applied(wide, dealt, runs, same, partial(cut_words, window=units.window), RESULTS, "n_words long, n_removed long, kept_text string")
    return restored(out, docs.columns, "doc_id", "text", results=list(RESULTS))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_passages(docs).select("doc_id", "n_words", "n_removed", sha("kept_text").alias("kept_sha256"))
