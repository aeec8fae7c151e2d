"""Content-routed candidates: which stretches of which documents can hold a shared window.

Every window of `window` units (words or bytes) belongs to the run of its anchor, a gram chosen
by content alone (see spans.anchor_runs), so equal windows have equal anchors. A window that
stands in two documents therefore has an anchor hash that two documents share. Two shuffles
find and route exactly those runs:

0. whole texts that equal one with a smaller doc_id are known by their digest; they take no
   part, as the first of them stands for all;
1. each group of documents sends its anchor hashes, with the first and last document that has
   each, packed into byte blocks; they meet by hash, and each hash found in two different
   documents is told to the groups that have it (a hash collision only adds a candidate);
2. documents emit the told runs, each a short stretch of text, to the shard of its anchor,
   where an exact method decides. Equal windows always meet in one shard.

Shards and groups are sized from the input, so their memory does not grow with it; a shard is
read as a sorted stream. Rows without doc_id neither remove nor lose anything.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import spans
from .common import parts_for, slices, texts_of, tidy

U = np.uint64
#: A removed run: units start .. start + length of the row of `doc` whose text has checksum `sig`.
REMOVED = np.dtype([("doc", "<i8"), ("sig", "<u4"), ("start", "<i8"), ("length", "<i8")])


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    words: bool
    window: int = 50
    gram: int = 20

    def runs(self, texts: list[bytes]) -> tuple[spans.Runs, np.ndarray, spans.Words | None, np.ndarray]:
        """Runs, the bytes they point into, the words, and the first unit of each text."""
        if self.words:
            j = spans.join(texts)
            w = spans.words(j)
            return spans.anchor_runs(w.hash, w.first, self.window, self.gram), j.data, w, w.first
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        return spans.anchor_runs(spans._BYTE[data], first, self.window, self.gram), data, None, first


@dataclass(frozen=True)
class Sizes:
    """How the work is dealt out; follows the input's size and never changes results."""

    parts: int
    groups: int
    shards: int

    @classmethod
    def of(cls, docs: DataFrame) -> Sizes:
        return cls(parts_for(docs, 8), parts_for(docs, 2), parts_for(docs, 1))


_PRIME, _FACTOR = (1 << 31) - 1, 1327217885


def group_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The group of each doc_id: a hash that sums and products below 2**63 can tell in SQL too."""
    return (np.mod(np.mod(ids, _PRIME) * _FACTOR, _PRIME) % n).astype(np.int32)


def grouped(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """The documents that have an id, with the group that tells and answers are sent to."""
    spread = F.pmod(F.pmod(F.col("doc_id").cast("long"), F.lit(_PRIME)) * F.lit(_FACTOR), F.lit(_PRIME))
    return docs.where("doc_id is not null").withColumn("_group", (spread % F.lit(sizes.groups)).cast("int"))


def copies(dealt: DataFrame) -> DataFrame:
    """(group, copy_id, copy_sig): documents whose whole text a smaller doc_id holds as well."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    marks = dealt.select("_group", F.col("doc_id").cast("long").alias("copy_id"), F.md5(raw).alias("digest"), F.crc32(raw).alias("copy_sig"))
    least = marks.groupBy("digest").agg(F.min("copy_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return marks.join(least.hint("merge"), "digest").where("copy_id > least").select("_group", "copy_id", "copy_sig")


def answers_and_copies(group_rows: DataFrame, copy_rows: DataFrame, *names: str) -> DataFrame:
    """Answers for document groups and the copies among them, as one table."""
    return group_rows.select("_group", *names, F.lit(None).cast("long").alias("copy_id"), F.lit(None).cast("long").alias("copy_sig")).union(
        copy_rows.select("_group", *(F.lit(None).cast("binary").alias(n) for n in names), "copy_id", "copy_sig")
    )


def _is_copy(docs: pa.RecordBatch, texts: list[bytes], known: set[tuple[int, int]]) -> np.ndarray:
    return np.array([(d, zlib.crc32(t)) in known for d, t in zip(docs.column("doc_id").to_pylist(), texts, strict=True)], bool)


def copies_of(answers: pa.Table) -> set[tuple[int, int]]:
    got = zip(answers.column("copy_id").to_pylist(), answers.column("copy_sig").to_pylist(), strict=True)
    return {x for x in got if x[0] is not None}


def filled(answers: pa.Table, name: str) -> list[bytes]:
    return [x for x in answers.column(name).to_pylist() if x is not None]


def sent(grouped_docs: DataFrame, copy_rows: DataFrame, units: Units, sizes: Sizes) -> DataFrame:
    """(part, docs, keys): a group's anchors, each with the first and the last document that has it, dealt out by anchor.

    So an anchor that very many documents have comes from each group twice at most."""
    n_parts = sizes.parts

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, owners = [np.zeros(0, U)], [np.zeros(0, "<i8")]
        known = copies_of(answers)
        for batch in docs.select(["doc_id", "text"]).to_batches():
            for piece in slices(batch, "text", 600_000):
                ids, texts = piece.column("doc_id"), texts_of(piece)
                out = np.asarray(ids.is_null()) | _is_copy(piece, texts, known)
                runs, _, _, _ = units.runs([b"" if o else t for o, t in zip(out.tolist(), texts, strict=True)])
                keys.append(runs.key >> U(16))
                owners.append(np.asarray(ids.fill_null(0).cast(pa.int64()))[runs.doc].astype("<i8"))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        last = np.append(first[1:], len(key))[: len(first)] - 1
        more = last[owner[last] != owner[first]]
        key, owner = np.concatenate([key[first], key[more]]), np.concatenate([owner[first], owner[more]])
        part = (key % U(n_parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        key, owner, part = key[order], owner[order], part[order]
        cut = np.flatnonzero(np.diff(part)) + 1
        rows = [(int(p[0]), o.tobytes(), k.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for p, o, k in zip(np.split(part, cut), np.split(owner, cut), np.split(key, cut), strict=True) if len(p)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "docs": pa.array([r[1] for r in rows], pa.binary()), "keys": pa.array([r[2] for r in rows], pa.binary())})

    return grouped_docs.groupBy("_group").cogroup(copy_rows.groupBy("_group")).applyInArrow(tidy(send), "part int, docs binary, keys binary")


def met(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, owner) of the anchors that two different documents have, by anchor."""
    owner = np.concatenate([np.frombuffer(x, "<i8") for x in rows.column("docs").to_pylist()])
    raw = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("keys").to_pylist()]).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    key = wide.view("<u8").ravel()
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    shared = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
    pick = np.repeat(shared, np.diff(np.append(start, len(key))))
    return key[pick], owner[pick]


def told(grouped_docs: DataFrame, copy_rows: DataFrame, units: Units, sizes: Sizes) -> DataFrame:
    """(group, keys): the anchors that stand in two or more documents, for each group that has one."""
    n_groups = sizes.groups

    def meet(rows: pa.Table) -> pa.Table:
        key, owner = met(rows)
        group = group_of(owner, n_groups)
        order = np.argsort(group, kind="stable")
        key, group = key[order], group[order]
        cut = np.flatnonzero(np.diff(group)) + 1
        got = [(int(g[0]), np.unique(k).tobytes()) for g, k in zip(np.split(group, cut), np.split(key, cut), strict=True) if len(g)]
        return pa.table({"_group": pa.array([g[0] for g in got], pa.int32()), "keys": pa.array([g[1] for g in got], pa.binary())})

    return sent(grouped_docs, copy_rows, units, sizes).groupBy("part").applyInArrow(tidy(meet), "_group int, keys binary")


#: Stretches packed by shard: doc_id, text checksum, first unit and number of windows of each, its size and its bytes.
CANDIDATE = "shard int, docs binary, sigs binary, los binary, wins binary, sizes binary, bodies binary"
_FIELDS = [f.split()[0] for f in CANDIDATE.split(", ")]
_KINDS = ("<i8", "<u4", "<i8", "<i4", "<i4", "u1")


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of each stretch, end to end."""
    out = np.empty(int(size.sum()), data.dtype)
    ends = np.cumsum(size)
    step = 0
    while step < len(size):  # the index of a part at a time
        done = int(ends[step - 1]) if step else 0
        stop = max(step + 1, int(np.searchsorted(ends, done + 1_000_000, "right")))
        n = size[step:stop]
        at = np.arange(int(n.sum())) + np.repeat(start[step:stop] - (np.cumsum(n) - n), n)
        out[done : done + len(at)] = data[at]
        step = stop
    return out


@dataclass
class Stretches:
    """Stretches of text: each holds `win` windows from unit `lo` of the text `sig` of `doc` on."""

    doc: np.ndarray
    sig: np.ndarray
    lo: np.ndarray
    win: np.ndarray
    size: np.ndarray
    body: np.ndarray

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size, dtype=np.int64) - self.size

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, order: np.ndarray) -> Stretches:
        return Stretches(self.doc[order], self.sig[order], self.lo[order], self.win[order], self.size[order], gathered(self.body, self.start[order], self.size[order].astype(np.int64)))

    @classmethod
    def join(cls, parts: list[Stretches]) -> Stretches:
        if not parts:
            return cls(*(np.zeros(0, k) for k in _KINDS))
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("doc", "sig", "lo", "win", "size", "body")))

    def keys(self) -> np.ndarray:
        """A hash of each stretch's bytes."""
        out = np.empty(len(self), U)
        for a, b, at in self.parts():
            start = self.start[a:b] - at
            body = self.body[at : at + int(start[-1]) + int(self.size[b - 1])]
            out[a:b] = spans.range_hash(spans.prefix_hash(spans._BYTE[body]), start, start + self.size[a:b])
        return out

    def parts(self, limit: int = 1_000_000) -> Iterator[tuple[int, int, int]]:
        """(first, behind the last, first byte) of stretches that make up about `limit` bytes."""
        ends, a = np.cumsum(self.size, dtype=np.int64), 0
        while a < len(self):
            at = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, at + limit, "right")))
            yield a, b, at
            a = b

    def held_before(self, key: np.ndarray) -> np.ndarray:
        """Which stretches equal one of a smaller doc_id here. key: a hash; bytes decide."""
        order = np.lexsort((self.doc, self.size, key))
        same = np.zeros(len(order), bool)
        same[1:] = (key[order][1:] == key[order][:-1]) & (self.size[order][1:] == self.size[order][:-1])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = order[same & (self.doc[order] > self.doc[head])]
        head = head[same & (self.doc[order] > self.doc[head])]
        out = np.zeros(len(self), bool)
        start, size = self.start, self.size.astype(np.int64)
        for k in range(0, len(later), 4096):
            a, b = later[k : k + 4096], head[k : k + 4096]
            unlike = gathered(self.body, start[a], size[a]) != gathered(self.body, start[b], size[b])
            out[a] = ~np.logical_or.reduceat(unlike, np.cumsum(size[a]) - size[a])
        return out

    def packed(self, shard: np.ndarray) -> list[tuple]:
        """Rows of CANDIDATE, one for each shard."""
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        whole, shard = self.take(order), shard[order]
        ends = np.append(cut, len(shard))
        edge = np.concatenate([[0], np.cumsum(whole.size, dtype=np.int64)])
        return [(int(shard[a]), *(np.ascontiguousarray(x[a:b].astype(k)).tobytes() for x, k in zip((whole.doc, whole.sig, whole.lo, whole.win, whole.size), _KINDS, strict=False)), whole.body[edge[a] : edge[b]].tobytes()) for a, b in zip(np.concatenate([[0], cut]), ends, strict=True) if b > a]

    def removals(self, flags: np.ndarray, window: int) -> np.ndarray:
        """REMOVED records of the flagged windows; flags: all windows of all stretches in a row."""
        if not flags.any():
            return np.zeros(0, REMOVED)
        win = self.win.astype(np.int64)
        first = np.cumsum(win) - win
        begin = flags.copy()
        inner = np.ones(len(flags), bool)
        inner[first] = False
        begin[1:] &= ~(flags[:-1] & inner[1:])
        stop = flags.copy()
        stop[:-1] &= ~(flags[1:] & inner[1:])
        a, b = np.flatnonzero(begin), np.flatnonzero(stop)
        of = np.searchsorted(first, a, "right") - 1
        out = np.empty(len(a), REMOVED)
        out["doc"], out["sig"], out["start"], out["length"] = self.doc[of], self.sig[of], self.lo[of] + a - first[of], b - a + window
        return out


@dataclass
class Piece:
    """A slice of a group's texts as the emitter sees it."""

    own: np.ndarray
    sig: np.ndarray
    first: np.ndarray
    data: np.ndarray
    start: np.ndarray | None = None
    values: np.ndarray | None = None
    runs: spans.Runs | None = None

    @staticmethod
    def _texts(batch: pa.RecordBatch, known: set[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids, checksums and texts; a copy counts as empty."""
        texts = texts_of(batch)
        sig = np.array([zlib.crc32(t) for t in texts], "<u4")
        ids = batch.column("doc_id").to_pylist()
        return np.array(ids, "<i8"), sig, [b"" if (d, s) in known else t for d, s, t in zip(ids, sig.tolist(), texts, strict=True)]

    @classmethod
    def of(cls, batch: pa.RecordBatch, known: set[tuple[int, int]], units: Units) -> Piece:
        """With the runs of its bytes or words."""
        ids, sig, texts = cls._texts(batch, known)
        runs, data, w, first = units.runs(texts)
        if w is None:
            return cls(ids, sig, first, data, runs=runs)
        plain, start = spans.single_spaced(data, w)
        return cls(ids, sig, first, plain, start, w.hash, runs)

    @classmethod
    def words(cls, batch: pa.RecordBatch, known: set[tuple[int, int]]) -> Piece:
        """Its words alone."""
        ids, sig, texts = cls._texts(batch, known)
        j = spans.join(texts)
        w = spans.words(j)
        plain, start = spans.single_spaced(j.data, w)
        return cls(ids, sig, w.first, plain, start, w.hash)

    def stretches(self, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[Stretches, np.ndarray]:
        """The windows lo .. hi of each, and a hash of their bytes."""
        a = lo if self.start is None else self.start[lo]
        b = hi + window if self.start is None else self.start[hi + window]
        body = gathered(self.data, a, b - a)
        key = spans.range_hash(spans.prefix_hash(spans._BYTE[self.data] if self.values is None else self.values), lo, hi + window)
        return Stretches(self.own[doc], self.sig[doc], lo - self.first[doc], (hi - lo + 1).astype("<i4"), (b - a).astype("<i4"), body), key


def candidates(grouped_docs: DataFrame, told_rows: DataFrame, copy_rows: DataFrame, units: Units, sizes: Sizes) -> DataFrame:
    """The told runs as stretches for their shards, as rows of CANDIDATE."""

    def emit(docs: pa.Table, answers: pa.Table) -> pa.Table:
        blocks = filled(answers, "keys")
        if not blocks or not docs.num_rows:
            return as_candidates([], [], [], sizes)
        known = copies_of(answers)
        wanted = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in blocks]))
        parts, keys, shards = [], [], []
        for batch in docs.select(["doc_id", "text"]).to_batches():
            for part in slices(batch, "text", 600_000):
                piece = Piece.of(part, known, units)
                k = those(piece, wanted)
                if len(k):
                    at = piece.runs.key[k] >> U(16)
                    got, body_key = piece.stretches(piece.runs.doc[k], piece.runs.lo[k], piece.runs.hi[k], units.window)
                    parts.append(got)
                    keys.append(body_key ^ at)
                    shards.append(at)
        return as_candidates(parts, keys, shards, sizes)

    right = answers_and_copies(told_rows, copy_rows, "keys")
    return grouped_docs.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(tidy(emit), CANDIDATE)


def those(piece: Piece, wanted: np.ndarray) -> np.ndarray:
    """The runs of a piece whose anchor is wanted."""
    key = piece.runs.key >> U(16)
    return np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)


def as_candidates(parts: list[Stretches], keys: list[np.ndarray], routes: list[np.ndarray], sizes: Sizes) -> pa.Table:
    """Rows of CANDIDATE for a group's stretches; routes: what each is dealt out by, keys: a hash that equal ones share.

    A stretch that a smaller doc_id of the group holds too is decided on the spot: it goes to a
    negative shard, without its text, so a passage that stands in very many documents sends one
    text per group to its shard."""
    rows: list[tuple] = []
    if parts:
        whole, shard = Stretches.join(parts), (np.concatenate(routes) % U(sizes.shards)).astype(np.int32)
        here = whole.held_before(np.concatenate(keys))
        rows = whole.take(np.flatnonzero(~here)).packed(shard[~here])
        if here.any():
            told_off = whole.take(np.flatnonzero(here))
            told_off.size, told_off.body = np.zeros(len(told_off), "<i4"), np.zeros(0, np.uint8)
            rows += told_off.packed(np.full(len(told_off), -1 - int(told_off.doc[0]) % 1_000_003, np.int32))
    return pa.table({f: pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k, f in enumerate(_FIELDS)})


def window_ranks(units: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """Order-preserving numbers of the `window` units from each start on, by prefix multiplying.

    Exact, no hashing: numbers of short runs are put side by side in 63 bits and numbered again,
    only at the places that the starts come to need."""
    if not len(starts):
        return np.zeros(0, np.int64)
    n = len(units)
    names, rank = np.unique(units, return_inverse=True)
    lengths, bits = [1], [max(1, (len(names) - 1).bit_length())]
    while lengths[-1] < window:
        lengths.append(min(window, lengths[-1] * (63 // bits[-1])))
        bits.append(n.bit_length())
    need = np.zeros(n, bool)
    need[starts] = True
    steps = []
    for short, long, width in zip(lengths[-2::-1], lengths[:0:-1], bits[-2::-1], strict=True):
        offsets = [*range(0, long - short, short), long - short]
        at = np.flatnonzero(need)
        steps.append((at, offsets, width))
        for o in offsets[1:]:
            need[at + o] = True
    for at, offsets, width in reversed(steps):
        key = np.zeros(len(at), np.int64)
        for o in offsets:
            key = (key << width) | rank[at + o]
        rank = np.empty(n, np.int64)
        rank[at] = np.unique(key, return_inverse=True)[1]
    return rank[starts]


def removed(rows: DataFrame, decide: Callable[[Stretches], np.ndarray], units: Units, sizes: Sizes) -> DataFrame:
    """(group, runs): REMOVED records by document group. decide: those of one shard."""
    n_groups, window = sizes.groups, units.window

    def dealt_out(got: np.ndarray) -> pa.RecordBatch:
        group = group_of(got["doc"], n_groups)
        order = np.argsort(group, kind="stable")
        got, group = got[order], group[order]
        cut = np.flatnonzero(np.diff(group)) + 1
        parts = [(int(g[0]), x.tobytes()) for g, x in zip(np.split(group, cut), np.split(got, cut), strict=True) if len(g)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["_group", "runs"])

    def judged(held: list[Stretches]) -> np.ndarray:
        shard = Stretches.join(held)
        held.clear()
        here = shard.held_before(shard.keys())  # a whole stretch again: its first one stands for it
        again = shard.take(np.flatnonzero(here))
        return np.concatenate([again.removals(np.ones(int(again.win.sum()), bool), window), decide(shard.take(np.flatnonzero(~here)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for number, *raw in zip(*(batch.column(f).to_pylist() for f in _FIELDS), strict=True):
                if held and number != at:
                    yield dealt_out(judged(held))
                got = Stretches(*(np.frombuffer(x, k) for x, k in zip(raw, _KINDS, strict=True)))
                if number < 0:
                    yield dealt_out(got.removals(np.ones(int(got.win.sum()), bool), window))
                else:
                    at = number
                    held.append(got)
        if held:
            yield dealt_out(judged(held))

    dealt = rows.repartition(max(sizes.parts, 1), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(tidy(run), "_group int, runs binary")


def coverage(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n units the runs cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(runs["start"], n), 1)
    np.add.at(edge, np.minimum(runs["start"] + runs["length"], n), -1)
    return np.cumsum(edge[:-1]) > 0


WHOLE = np.array([(0, 0, 0, 1 << 40)], REMOVED)


def applied(wide: DataFrame, dealt: DataFrame, removed_rows: DataFrame, copy_rows: DataFrame, cut: Callable[[bytes, np.ndarray | None], tuple], results: dict[str, pa.DataType], schema: str) -> DataFrame:
    """The rows of `wide` plus what `cut(text, runs)` gives for each; rows without id need no shuffle."""
    keep = wide.columns

    def made(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate(results.values())]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known = copies_of(answers)
        got = np.concatenate([np.zeros(0, REMOVED), *(np.frombuffer(x, REMOVED) for x in filled(answers, "runs"))])
        got = got[np.lexsort((got["sig"], got["doc"]))]
        rows = []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist(), strict=True):
            text = text or b""
            mine = None
            if (known or len(got)) and (doc_id, sig := zlib.crc32(text)) in known:
                mine = WHOLE
            elif len(got):
                mine = got[np.searchsorted(got["doc"], doc_id) : np.searchsorted(got["doc"], doc_id, "right")]
                mine = mine[mine["sig"] == sig]
            rows.append(cut(text, mine if mine is not None and len(mine) else None))
        return pa.table({**{c: docs.column(c) for c in keep}, **dict(zip(results, made(rows), strict=True))})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, *made([cut(t, None) for t in texts_of(part)])], [*keep, *results])

    both = StructType([*wide.schema.fields, *StructType.fromDDL(schema).fields])
    right = answers_and_copies(removed_rows, copy_rows, "runs")
    done = dealt.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(tidy(run), both)
    return done.union(wide.where("doc_id is null").mapInArrow(tidy(whole), both))
