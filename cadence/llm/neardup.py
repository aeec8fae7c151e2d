"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles (weight: occurrences; a text of fewer
words is one shingle). Exact copies fold into one row first, with the smallest doc_id. Bands of
the DartMinHash signature propose pairs; a pair links if its weighted Jaccard similarity, counted
on the shingles' 40-bit hashes, is at least `threshold`. Classes are the connected components of the links.

Not all pairs of a bucket are looked at, yet no link between classes is lost:
1. star rounds link each bucket's rows to one centre, which folds large groups of near copies;
2. then every pair of a bucket whose two sides lie in different classes is compared, in blocks
   inside a task (in the pair's smallest shared bucket only), and just enough links come out to
   connect what is linked; pairs inside a class cannot change anything.

Scale: signatures are map-only; bands travel as 64-bit keys; buckets are counted with partial
sums before anything is joined to them; shingle sets are sent only for rows that share one. No
table is broadcast, components run on written tables, the driver sees a few counts.

Defined results: a text without words (null, empty) and a row without doc_id stay alone (class
= doc_id); rows that share a doc_id but not the text have classes of their own, by their texts;
`n_copies` counts identical texts; an empty table gives no rows; extra columns are ignored; very
long texts are signed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import darts, spans
from .common import shuffle_partitions, slices, staged, table, texts_of, tidy
from .components import components

U = np.uint64
SHINGLE = 5
BANDS, ROWS = 32, 5


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text, occurrences; ordered by text, then hash."""
    w = spans.words(spans.join(texts))
    n = len(w.hash) - size + 1
    own = key = np.zeros(0, np.int64)
    if n > 0:
        at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
        own, key = w.doc[at], spans.grams(w.hash, size)[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = spans.range_hash(spans.prefix_hash(w.hash), w.first[short], w.first[short + 1])
        own, key = np.concatenate([own, short]), np.concatenate([key.astype(U), whole])
    key = key.astype(U)
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    start = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))) if len(own) else np.zeros(0, np.int64)
    return key[start], own[start], np.diff(np.append(start, len(own)))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest of the text (null without words) and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = texts_of(piece)
                key, own, count = shingles(texts)
                sig = darts.signatures(key, own, count.astype(float), len(texts), bands * rows)
                has = np.bincount(own, minlength=len(texts)) > 0
                keys = darts.band_keys(sig, bands, rows).view(np.int64)
                digest = [hashlib.md5(t).digest() if h else None for t, h in zip(texts, has.tolist(), strict=True)]
                flat = pa.array(keys.ravel())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * bands, flat)], ["doc_id", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, digest binary, bands array<long>")


def cells_of(texts: list[bytes]) -> list[bytes]:
    """Each text's shingle occurrences as a set (the n-th occurrence is an element of its own).

    Sorted 40-bit hashes, 5 bytes each; plain Jaccard of these sets is weighted Jaccard."""
    key, own, count = shingles(texts)
    cell, own, _ = darts.unit_cells(key, own, count.astype(float))
    cell >>= U(24)
    order = np.lexsort((cell, own))
    cut = np.searchsorted(own[order], np.arange(len(texts) + 1))
    raw = np.ascontiguousarray(cell[order]).view(np.uint8).reshape(-1, 8)[:, :5]
    return [raw[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]


def opened(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    low = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return low / (len(a) + len(b) - low)


def text_digest() -> Column:
    """The digest of the text; the same bytes as `signed` gives for a text that has words."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def celled(docs: DataFrame, some: DataFrame) -> DataFrame:
    """(id, cells) of the texts in `some`: doc_id, digest, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(cells_of(texts_of(piece)), pa.binary())], ["id", "cells"])

    texts = docs.where("doc_id is not null").withColumn("digest", text_digest()).join(some.hint("shuffle_hash"), ["doc_id", "digest"]).select("id", "text")
    return texts.mapInArrow(tidy(run), "id long, cells binary").groupBy("id").agg(F.min("cells").alias("cells"))


def verified(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = zip(batch.column("cells_a").to_pylist(), batch.column("cells_b").to_pylist(), strict=True)
            good = pa.array([similarity(opened(x), opened(y)) >= threshold for x, y in raw], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    side = lambda c: cells.select(F.col("id").alias(c), F.col("cells").alias(f"cells_{c}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "cells_a", "cells_b").mapInArrow(tidy(run), "a long, b long")


class Crowd:
    """The rows of one bucket (or of two blocks of it), compared across classes."""

    def __init__(self, rows: list[tuple], threshold: float):
        self.bucket, lo, hi = rows[0][:3]
        self.cross = lo != hi
        self.half = np.array([r[3] for r in rows], np.int64)
        self.ids = np.array([r[4] for r in rows], np.int64)
        self.root = np.array([r[5] for r in rows], np.int64)
        self.others = [r[6] for r in rows]
        self.sets = [opened(r[7]) for r in rows]
        self.threshold = threshold

    def pairs(self) -> np.ndarray:
        """Which pairs are this bucket's to compare: of two classes, sharing no smaller bucket."""
        low = [[b for b in o if b < self.bucket] for o in self.others]
        names, count = np.unique(np.concatenate([np.array(x, np.int64) for x in low]), return_counts=True)
        names = names[count > 1]
        member = np.zeros((len(low), len(names)), np.float32)
        for k, x in enumerate(low):
            at = np.searchsorted(names, x)
            ok = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == x) if len(names) else np.zeros(len(x), bool)
            member[k, at[ok]] = 1
        todo = (self.root[:, None] != self.root[None, :]) & ~(member @ member.T > 0)
        if self.cross:
            todo &= self.half[:, None] != self.half[None, :]
        return todo

    def edges(self) -> list[tuple[int, int]]:
        """Links enough to connect all that is linked here."""
        todo = self.pairs()
        a, b = np.nonzero(np.triu(todo, 1))
        if len(a) <= 60 * len(self.ids):
            good = np.array([similarity(self.sets[x], self.sets[y]) >= self.threshold for x, y in zip(a, b, strict=True)], bool)
            linked = np.zeros_like(todo)
            linked[a[good], b[good]] = linked[b[good], a[good]] = True
        else:
            linked = todo & (self.all_similarities() >= self.threshold)
        n = len(linked)
        label = np.arange(n)
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        return [(int(self.ids[k]), int(self.ids[label[k]])) for k in np.flatnonzero(label != np.arange(n))]

    def all_similarities(self) -> np.ndarray:
        """Set sizes in common as one matrix product, over stretches of the elements."""
        size = np.array([len(x) for x in self.sets])
        row = np.repeat(np.arange(len(size)), size)
        _, place, count = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        use = count > 1
        column = (np.cumsum(use) - 1)[place]
        keep = use[place]
        row, column = row[keep], column[keep]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(size), len(size)), np.float32)
        for lo in range(0, int(use.sum()), 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            part = np.zeros((len(size), 4096), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            common += part @ part.T
        return common / np.maximum(size[:, None] + size[None, :] - common, 1)


def crossed(mixed: DataFrame, cells: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """Links (a, b) between classes that meet in a bucket. mixed: bucket, id, root.

    Pairs are compared in blocks inside a task and never written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def close() -> pa.RecordBatch:
            found = Crowd(group, threshold).edges() if len(group) > 1 else []
            group.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lo", "hi", "half", "id", "root", "buckets", "cells")), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield close()
                group.append(row)
        if group:
            yield close()

    own = mixed.groupBy("id").agg(F.collect_set("bucket").alias("buckets")).join(cells.hint("merge"), "id")
    size = mixed.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    dealt = mixed.select("bucket", "id", "root").join(size.hint("merge"), "bucket").withColumn("half", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("half", "other").alias("lo"), F.greatest("half", "other").alias("hi"), "half", "id", "root")
    rows = dealt.join(own.hint("merge"), "id").select("bucket", "lo", "hi", "half", "id", "root", "buckets", "cells")
    parts = shuffle_partitions(mixed.sparkSession)
    return rows.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(tidy(run), "a long, b long")


def links(docs: DataFrame, reps: DataFrame, threshold: float, rounds: int = 2) -> DataFrame:
    """(node, root) over class representatives. reps: id, doc_id, digest, bands."""
    rows = staged(reps.select("id", F.explode("bands").alias("bucket")), "bands")
    crowd = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(rows.join(crowd.hint("merge"), "bucket").select("bucket", "id"), "buckets")
    some = reps.select("id", "doc_id", "digest").join(rows.select("id").distinct().hint("merge"), "id", "left_semi")
    cells = staged(celled(docs, some), "near-cells")

    edges = tested = roots = None
    for turn in range(rounds):
        # a bucket's centre: its smallest id, then the least by a hash among rows of other classes
        rank = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        where = rows if roots is None else _classed(rows, roots)
        if roots is None:
            centre = where.groupBy("bucket").agg(F.min("id").alias("b"))
            pairs = where.join(centre.hint("merge"), "bucket").where("id <> b")
        else:
            where = _mixed(where)
            centre = where.where("not main").groupBy("bucket").agg(F.min(F.struct(rank.alias("r"), "id", "root")).alias("c")).select("bucket", F.col("c.id").alias("b"), F.col("c.root").alias("root_b"))
            pairs = where.join(centre.hint("merge"), "bucket").where("id <> b and root <> root_b")
        pairs = pairs.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
        edges, tested, roots = _grow(pairs, cells, edges, tested, threshold)
    fresh = staged(crossed(staged(_mixed(_classed(rows, roots)), "mixed"), cells, threshold), "links")
    return staged(components(edges.union(fresh)), "roots")


def _grow(pairs: DataFrame, cells: DataFrame, edges: DataFrame | None, tested: DataFrame | None, threshold: float):
    if tested is not None:
        pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
    pairs = staged(pairs, "pairs")
    fresh = staged(verified(pairs, cells, threshold), "links")
    edges = fresh if edges is None else edges.union(fresh)
    return edges, pairs if tested is None else tested.union(pairs), staged(components(edges), "roots")


def _classed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold two or more classes; `main` marks the bucket's largest class."""
    per = rows.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    best = per.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("m", "root")).alias("top")).where("classes > 1")
    return rows.join(best.select("bucket", F.col("top.root").alias("top")).hint("merge"), "bucket").select("bucket", "id", "root", (F.col("root") == F.col("top")).alias("main"))


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), n_copies, kept, and
    `digest` of its text (null without words). Of a class, the text that is kept is marked."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = staged(signed(docs, bands, rows), "signatures")
    whole = signs.where("digest is not null and doc_id is not null")
    copies = whole.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))
    # the texts of one id are told apart: the first goes by the id, others by a made-up negative number
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
    other = F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("doc_id", "digest"), 3)
    copies = staged(copies.withColumn("id", F.when(nth == 1, F.col("doc_id")).otherwise(other)), "copies")
    reps = whole.join(copies.select("doc_id", "digest", "id").hint("merge"), ["doc_id", "digest"]).groupBy("id").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.min("bands").alias("bands"))
    roots = links(docs, staged(reps, "texts"), threshold)
    found = copies.join(roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").select("digest", "doc_id", "n_copies", F.coalesce("root", "id").alias("root"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    found = found.join(first.hint("merge"), "root").select("digest", "n_copies", F.col("first.doc_id").alias("class_id"), F.col("first.digest").alias("kept_digest"))
    out = signs.select("doc_id", "digest").join(found.hint("merge"), "digest", "left")
    kept = F.coalesce((F.col("class_id") == F.col("doc_id")) & (F.col("kept_digest") == F.col("digest")), F.lit(True))
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), kept.alias("kept"), "digest")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("digest")
