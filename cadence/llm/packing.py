"""Sum-of-squares online packing of token sequences.

A level array counts the partially filled windows by fill level. A document goes, as it comes,
to the level (or a new window) that leaves the sum of the squared counts least, which keeps the
levels even and so finds a partner for most remainders. A document longer than a window first
fills whole windows; its remainder is placed by the same rule.

When a stream ends, the windows still open are closed: the fullest are filled up by cutting
pieces off the emptiest. What is left, less than one window, is cut at powers of two (such
sequences need no padding).

Scale: map-only, no shuffle. Each input partition is a stream of its own with its own level
array, so the work is linear in the tokens; sequence ids carry the partition number. What a task
holds is the level array, one text's ids, and its open windows with their ids; how many windows
are open at a level is bounded by the partition only, as the rule keeps them for partners. A stream's order is its input order, so a rerun of a lost task gives the same sequences.

Defined results: null or empty text is one end id; repeated rows are packed as separate
documents; very long texts are encoded whole and fill windows of their own; an empty table gives
no rows; extra columns are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy
from .tokens import encoder, with_end

WINDOW = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.ids[: 4 * at], self.doc_tokens)
        return head, Piece(self.doc_id, self.start + at, self.ids[4 * at :], self.doc_tokens)


@dataclass
class Packer:
    """Places documents one by one; `done` gathers the closed sequences."""

    window: int = WINDOW
    done: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self):
        self.count = np.zeros(self.window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def add(self, doc_id: int | None, ids: bytes) -> None:
        rest = Piece(doc_id, 0, ids, len(ids) // 4)
        while len(rest) >= self.window:
            head, rest = rest.cut(self.window)
            self.done.append([head])
        if len(rest):
            self._place(rest)

    def _place(self, piece: Piece) -> None:
        size = len(piece)
        level = self.best_level(size)
        if level:
            group = self.open[level].pop()
            self.count[level] -= 1
        else:
            group = []
        group.append(piece)
        level += size
        if level == self.window:
            self.done.append(group)
        else:
            self.open.setdefault(level, []).append(group)
            self.count[level] += 1

    def best_level(self, size: int) -> int:
        """The fill level (0: a new window) with the least change of the sum of squared counts.

        Ties go to the fullest level."""
        n, w = self.count, self.window
        change = 2 * n[size : w + 1] + 1  # of the level reached, from levels 0 .. w - size
        change[w - size] = 0  # a full window is no longer counted
        left = 1 - 2 * n[: w - size + 1]
        left[0] = 0
        cost = np.where((n[: w - size + 1] > 0) | (np.arange(w - size + 1) == 0), change + left, np.iinfo(np.int64).max)
        return w - size - int(np.argmin(cost[::-1]))

    def finish(self) -> None:
        """Close all open windows."""
        groups = [g for level in sorted(self.open, reverse=True) for g in self.open[level]]
        self.open, self.count[:] = {}, 0
        room = 0
        lo, hi = 0, len(groups) - 1
        donors: list[Piece] = []
        while lo <= hi:
            group = groups[lo]
            lo += 1
            room = self.window - sum(map(len, group))
            while room and (donors or lo <= hi):
                if not donors:
                    donors = groups[hi][::-1]
                    hi -= 1
                piece = donors.pop()
                if len(piece) > room:
                    piece, back = piece.cut(room)
                    donors.append(back)
                group.append(piece)
                room -= len(piece)
            if not room:
                self.done.append(group)
            else:
                donors = group[::-1]
        while donors:  # less than two windows: full ones, then powers of two
            total = sum(map(len, donors))
            want = min(self.window, 1 << (total.bit_length() - 1))
            group = []
            while want:
                piece = donors.pop()
                if len(piece) > want:
                    piece, back = piece.cut(want)
                    donors.append(back)
                group.append(piece)
                want -= len(piece)
            self.done.append(group)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: document, place in it, length, checksum, sequence and offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer = encoder(tokenizer), Packer(window)
        sequence = TaskContext.get().partitionId() << 32

        def drain() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for group in packer.done:
                offset = 0
                for p in group:
                    rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, offset))
                    offset += len(p)
                sequence += 1
            packer.done.clear()
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

        for batch in batches:
            for piece in slices(batch, "text", 1_000_000):
                ids = enc.encode([t or "" for t in piece.column("text").to_pylist()])
                for doc_id, raw in zip(piece.column("doc_id").to_pylist(), ids, strict=True):
                    packer.add(doc_id, with_end(raw))
                yield drain()
        packer.finish()
        yield drain()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
