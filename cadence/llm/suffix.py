"""Suffix arrays in a logarithmic index family: remove byte strings an earlier document holds.

Each shard (see routing.py: equal strings meet in one shard) keeps levels. A level is a suffix
array: 32-bit positions into the level's own bytes, in the order of the `window` bytes that
follow each, equal ones once, with the smallest doc_id of each. Stretches are taken in ascending
doc_id order. A new batch gets its suffix array by prefix multiplying; it is merge-scanned against
every level for matches of `window` bytes; then it joins the family, where two levels of about
equal size merge, in one linear pass over both, into one of twice the size, so a string takes
part in O(log n) merges.

Scale: positions cost 12 bytes each whatever the window; merges and scans compare the bytes of
a bounded block of both arrays at a time. A shard's family is bounded by the shard's share of
candidates; batches bound what is sorted at once.

Defined results: null text has no bytes; a document without an id is left whole and removes
nothing; rows that share a doc_id never remove each other's bytes; an empty table gives no
rows; extra columns pass through, but those named like a result give way to it; very long texts
are cut into windows like any other; strings may start and end inside a UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import carried, restored, sha, staged, table
from .routing import REMOVED, Sizes, Stretches, Units, applied, candidates, copies, coverage, grouped, removed, told, window_ranks

UNITS = Units(words=False)


@dataclass
class Level:
    """A suffix array over `data`: distinct windows in order, with the smallest doc_id of each."""

    data: np.ndarray
    position: np.ndarray
    low: np.ndarray
    window: int

    def __len__(self) -> int:
        return len(self.position)

    def strings(self, a: int, b: int) -> np.ndarray:
        """The windows a .. b, as strings that compare like their bytes.

        A closing byte keeps trailing zero bytes from being taken as padding."""
        out = np.empty((b - a, self.window + 1), np.uint8)
        out[:, : self.window] = np.lib.stride_tricks.sliding_window_view(self.data, self.window)[self.position[a:b]]
        out[:, self.window] = 1
        return out.view(f"S{self.window + 1}").ravel()

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, docs: np.ndarray, window: int) -> tuple[Level, np.ndarray]:
        """The suffix array of the windows at `starts` (of ascending docs), and the place in it of each."""
        rank = window_ranks(data, window, starts)
        order = np.argsort(rank, kind="stable")
        new = np.append(True, rank[order][1:] != rank[order][:-1]) if len(order) else np.zeros(0, bool)
        place = np.empty(len(starts), np.int32)
        place[order] = np.cumsum(new) - 1
        head = order[new]
        return cls(data, starts[head].astype(np.int32), docs[head], window), place


def in_step(a: Level, b: Level, block: int = 32_768) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Walk two suffix arrays in step, block after block: (in_b, at, equal).

    The block's windows of both, merged (two sorted runs: one linear pass): whether each is of
    `b`, its place in its array, and whether it equals the one before it."""
    at_a = at_b = 0
    while at_a < len(a) or at_b < len(b):
        end_a, end_b = min(at_a + block, len(a)), min(at_b + block, len(b))
        left, right = a.strings(at_a, end_a), b.strings(at_b, end_b)
        # up to the lesser of the last windows: what comes later is above it in both
        last = [x[-1] for x, more in ((left, end_a < len(a)), (right, end_b < len(b))) if more and len(x)]
        if last:
            left = left[: np.searchsorted(left, min(last), "right")]
            right = right[: np.searchsorted(right, min(last), "right")]
        both = np.concatenate([left, right])
        order = np.argsort(both, kind="stable")
        equal = np.zeros(len(both), bool)
        equal[1:] = both[order[1:]] == both[order[:-1]]
        in_b = order >= len(left)
        yield in_b, np.where(in_b, order - len(left) + at_b, order + at_a), equal
        at_a, at_b = at_a + len(left), at_b + len(right)


def merged(a: Level, b: Level) -> Level:
    """One level of both, equal windows once."""
    position, low = [], []
    for in_b, at, equal in in_step(a, b):
        # of equal windows a's comes first, b's follows it
        p = np.empty(len(at), np.int32)
        p[~in_b], p[in_b] = a.position[at[~in_b]], b.position[at[in_b]] + len(a.data)
        d = np.empty(len(at), a.low.dtype)
        d[~in_b], d[in_b] = a.low[at[~in_b]], b.low[at[in_b]]
        twin = np.flatnonzero(equal)
        d[twin - 1] = np.minimum(d[twin - 1], d[twin])
        position.append(p[~equal])
        low.append(d[~equal])
    return Level(np.concatenate([a.data, b.data]), np.concatenate(position), np.concatenate(low), a.window)


@dataclass
class Family:
    """Levels of falling size."""

    levels: list[Level] = field(default_factory=list)

    def scan(self, batch: Level) -> np.ndarray:
        """Smallest doc_id, in the batch or any level, of each window of the batch."""
        low = batch.low.copy()
        for level in self.levels:
            for _, at, equal in in_step(level, batch):
                twin = np.flatnonzero(equal)
                mine, other = at[twin], at[twin - 1]
                low[mine] = np.minimum(low[mine], level.low[other])
        return low

    def add(self, batch: Level) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(batch):
            batch = merged(self.levels.pop(), batch)
        self.levels.append(batch)


def decide(shard: Stretches, window: int = UNITS.window, batch_bytes: int = 500_000) -> np.ndarray:
    """REMOVED records of one shard: its stretches, in doc_id order, batch after batch."""
    shard = shard.take(np.lexsort((shard.lo, shard.sig, shard.doc)))
    family, found = Family(), [np.zeros(0, REMOVED)]
    ends = np.cumsum(shard.size, dtype=np.int64)
    at = 0
    while at < len(shard):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + batch_bytes, "right")))
        part = shard.take(np.arange(at, stop))
        win = part.win.astype(np.int64)
        starts = np.arange(int(win.sum())) + np.repeat(part.start - (np.cumsum(win) - win), win)
        docs = np.repeat(part.doc, win)
        level, place = Level.of(part.body, starts, docs, window)
        flags = family.scan(level)[place] < docs
        found.append(part.removals(flags, window))
        family.add(level)
        at = stop
    return np.concatenate(found)


def cut_bytes(text: bytes, runs: np.ndarray | None, window: int = UNITS.window) -> tuple[int, int, int, bytes]:
    if runs is None or len(text) < window:
        return len(text), 0, 0, text
    gone = coverage(runs, len(text))
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


RESULTS = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_bytes": pa.binary()}


def remove_strings(docs: DataFrame, units: Units = UNITS, batch_bytes: int = 500_000) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans and kept_bytes."""
    sizes = Sizes.of(docs)
    wide = carried(docs, "doc_id", "text")
    dealt = grouped(wide, sizes)
    same = staged(copies(dealt), "copies")
    # the same dealt table three times: Spark shuffles it once
    rows = candidates(dealt, told(dealt, same, units, sizes), same, units, sizes)
    runs = removed(rows, partial(decide, window=units.window, batch_bytes=batch_bytes), units, sizes)
    out = applied(wide, dealt, runs, same, partial(cut_bytes, window=units.window), RESULTS, "n_bytes long, n_removed long, n_spans long, kept_bytes binary")
    return restored(out, docs.columns, "doc_id", "text", results=list(RESULTS))


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", sha("kept_bytes").alias("kept_sha256"))
