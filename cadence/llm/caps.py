"""Embedding near-duplicates by spherical-cap filters.

Filters are the directions of a structured product code: the dimensions are rotated and cut in
two, each half has `q` random unit codewords, and every pair of codewords is one of q * q
filters. A vector's score with a filter is the sum of its two half scores, so list decoding
needs 2 q dot products and then only the pairs whose sum reaches the cap: all filters above
`eta`, which is set so that about `per_vector` of them do, and at least the `least` best. Vectors
that share a filter are compared exactly, in double precision. q * q grows with the number of
vectors, so a filter holds less than one unrelated vector at any size; as narrower caps are
shared less often, `per_vector` grows with it: `width` raises it until random pairs exactly at
the threshold share a filter with the chance `recall`. The rotation makes any pair of vectors
as good as a random one, wherever its large components stand.

A pair is counted under its smallest shared filter only, so nothing is counted twice and no
pair is written out: a group of n vectors gives O(n) rows (link counts, and edges enough to
connect what is linked). Groups above `block` rows are dealt out as pairs of blocks.

Scale: equal vectors fold into one first. Filter ids travel without vectors until it is known
which filters are shared; no table is broadcast; the driver sees the number of vectors.

Recall is that of the filters, at least about `recall` for a pair at the threshold and more above
it (measured in the tests and the README); what is linked is exact. Defined results: a vector
that is null, empty, zero or has null or non-finite components links with nothing, as does one
without vec_id; vectors of different lengths never link; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, table, tidy
from .components import components


@lru_cache(maxsize=8)
def codewords(dim: int, q: int) -> tuple[np.ndarray, ...]:
    """For each half of the dimensions, q random unit directions; the same in every process."""
    rng = np.random.default_rng([dim, q, 7])
    out = []
    for size in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((q, max(size, 1)))
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        out.append(c[:, :size])
    return tuple(out)


@lru_cache(maxsize=8)
def rotations(dim: int) -> tuple[np.ndarray, ...]:
    """Random rotations of stretches of the dimensions; few dimensions are turned into 16."""
    rng = np.random.default_rng([dim, 11])
    sizes = [len(k) for k in np.array_split(np.arange(dim), math.ceil(dim / 256))]
    return tuple(np.linalg.qr(rng.standard_normal((max(n, 16), max(n, 16))))[0][:n] for n in sizes)


def rotated(x: np.ndarray) -> np.ndarray:
    turns = rotations(x.shape[1])
    cuts = np.cumsum([len(t) for t in turns])[:-1]
    return np.hstack([part @ t for part, t in zip(np.split(x, cuts, axis=1), turns, strict=True)])


def decode(x: np.ndarray, q: int, per_vector: int, least: int) -> list[np.ndarray]:
    """The filters of each unit vector, ascending."""
    x = rotated(x)
    dim = x.shape[1]
    left, right = codewords(dim, q)
    eta = NormalDist().inv_cdf(1 - min(0.5, per_vector / (q * q))) * math.sqrt(2 / dim)
    a, b = x[:, ::2] @ left.T, x[:, 1::2] @ right.T
    out = []
    for sa, sb in zip(a, b, strict=True):
        best = sb.max()
        # lower the cap until enough filters reach it
        cap = eta
        while True:
            ia = np.flatnonzero(sa >= cap - best)
            ib = np.flatnonzero(sb >= cap - sa.max())
            total = sa[ia][:, None] + sb[ib][None, :]
            pa_, pb_ = np.nonzero(total >= cap)
            if len(pa_) >= min(least, q * q):
                break
            cap -= 0.02
        codes = ia[pa_].astype(np.int64) * q + ib[pb_]
        if cap < eta and len(codes) > least:  # below the cap only the `least` best
            codes = codes[np.argsort(-total[pa_, pb_], kind="stable")[:least]]
        out.append(np.sort(codes))
    return out


def filters_across(n: int) -> int:
    """Codewords of a half for n vectors."""
    return max(16, math.ceil(math.sqrt(256 * max(n, 1))))


def at_once(q: int) -> int:
    """Vectors decoded together: their scores take some 64 MB."""
    return max(16, min(2000, 4_000_000 // q))


@lru_cache(maxsize=64)
def width(dim: int, q: int, threshold: float, recall: float, per_vector: int, least: int, pairs: int = 1000) -> tuple[int, int]:
    """(per_vector, least), raised until random pairs at the threshold share a filter often enough."""
    rng = np.random.default_rng([dim, 13])
    a, b = unit(rng.standard_normal((pairs, dim))), rng.standard_normal((pairs, dim))
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * unit(b) if dim > 1 else a
    step, first, missed = at_once(q), (per_vector, least), math.floor((1 - recall) * pairs)
    while per_vector < q * q:
        lost = 0
        for lo in range(0, pairs, step):
            both = (decode(x[lo : lo + step], q, per_vector, least) for x in (a, b))
            lost += sum(not np.intersect1d(f, g, assume_unique=True).size for f, g in zip(*both, strict=True))
            if lost > missed:
                break
        else:
            break
        per_vector = math.ceil(per_vector * 1.25)
        least = math.ceil(per_vector * first[1] / first[0])
    return per_vector, least


def filtered(vectors: DataFrame, q: int, threshold: float, recall: float, per_vector: int, least: int) -> DataFrame:
    """Adds `filters`, the ids of the vector's filters. vectors: id, mult, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once(q)):
                piece = batch.slice(at, at_once(q))
                rows = piece.column("embedding").to_pylist()
                got: list = [None] * len(rows)
                for dim in {len(r) for r in rows}:
                    pick = [k for k, r in enumerate(rows) if len(r) == dim]
                    x = unit(np.array([rows[k] for k in pick], np.float64))
                    for k, codes in zip(pick, decode(x, q, *width(dim, q, threshold, recall, per_vector, least)), strict=True):
                        got[k] = codes * 4096 + dim % 4096
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(got, pa.list_(pa.int64()))], [*piece.schema.names, "filters"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(tidy(run), f"id long, mult long, embedding {kind}, filters array<long>")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow, no underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _small(x: np.ndarray, group: np.ndarray, half: np.ndarray, cross: np.ndarray, bucket: np.ndarray, filters: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links whose smallest shared filter is the group's, over many small groups at once."""
    found_a, found_b = [], []
    step = 1
    while step < len(x):
        a = np.flatnonzero(group[step:] == group[:-step])
        if not len(a):
            break
        b = a + step
        ok = (np.einsum("ij,ij->i", x[a], x[b]) >= threshold) & (~cross[a] | (half[a] != half[b]))
        a, b = a[ok], b[ok]
        some = max(16, 2_000_000 // filters.shape[1] ** 2)
        for lo in range(0, len(a), some):
            p, r = a[lo : lo + some], b[lo : lo + some]
            fa = filters[p]
            fa = np.where(fa < bucket[p][:, None], fa, -1)
            first = ~((fa[:, :, None] == filters[r][:, None, :]) & (fa[:, :, None] >= 0)).any(axis=(1, 2))
            found_a.append(p[first])
            found_b.append(r[first])
        step += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _large(x: np.ndarray, half: np.ndarray, cross: bool, bucket: int, filters: np.ndarray, mult: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One large group: weighted link counts, and for each row the smallest row it is connected to."""
    n = len(x)
    row, place = np.nonzero((filters >= 0) & (filters < bucket))
    ids, column, count = np.unique(filters[row, place], return_inverse=True, return_counts=True)
    # filters that many rows have are multiplied (n * width memberships: few such), the others marked one by one
    many = count * 16 >= n
    member = np.zeros((n, int(many.sum())), np.float32)
    dense = many[column]
    member[row[dense], (np.cumsum(many) - 1)[column[dense]]] = 1
    earlier = np.zeros((n, n), bool)
    row, column = row[~dense], column[~dense]
    order = np.argsort(column, kind="stable")
    for rows in np.split(row[order], np.flatnonzero(np.diff(column[order])) + 1):
        if len(rows) > 1:
            earlier[rows[:, None], rows] = True
    links = np.zeros(n, np.int64)
    ok = np.zeros((n, n), bool)
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        good = x[lo:hi] @ x.T >= threshold
        good[np.arange(hi - lo), np.arange(lo, hi)] = False
        if cross:
            good &= half[lo:hi, None] != half[None, :]
        ok[lo:hi] = good
        first = good & ~earlier[lo:hi] & ~(member[lo:hi] @ member.T > 0)
        links[lo:hi] = first.astype(np.int64) @ mult
    label = np.arange(n)
    while True:
        new = label.copy()
        for lo in range(0, n, 512):
            near = np.where(ok[lo : lo + 512], label[None, :], n).min(axis=1)
            new[lo : lo + 512] = np.minimum(new[lo : lo + 512], near)
        new = new[new]
        if (new == label).all():
            return links, label
        label = new


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column without nulls, as arrays."""
    ends = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(zero_copy_only=False), (ends - ends[0])[1:-1]) if len(column) else []


def linked(members: DataFrame, threshold: float, least_large: int = 65) -> DataFrame:
    """(kind, a, b): kind 0 an edge between ids a and b; kind 1 that id a has b links here.

    members: bucket, lo, hi, half, id, mult, embedding, filters (those below the bucket will do);
    sorted by (bucket, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[tuple] = []
        group: list[tuple] = []
        key = None

        def answer(a, b, links, ids) -> pa.RecordBatch:
            has = np.flatnonzero(links)
            kind = np.concatenate([np.zeros(len(a), np.int32), np.ones(len(has), np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([ids[a], ids[has]])), pa.array(np.concatenate([ids[b], links[has]]))], ["kind", "a", "b"])

        def columns(rows: list[tuple]):
            most = max(1, max(len(r[7]) for r in rows))
            filters = np.full((len(rows), most), -2, np.int64)
            for k, r in enumerate(rows):
                filters[k, : len(r[7])] = r[7]
            return unit(np.array([r[6] for r in rows], np.float64)), filters, np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            """The current group goes to the pool, or is answered if it is large."""
            if len(group) >= least_large:
                x, filters, ids, mult, half = columns(group)
                links, label = _large(x, half, key[1] != key[2], key[0], filters, mult, threshold)
                other = np.flatnonzero(label != np.arange(len(label)))
                yield answer(other, label[other], links, ids)
            elif len(group) > 1:
                pool.extend(group)
            group.clear()

        def settle() -> Iterator[pa.RecordBatch]:
            by_dim: dict[int, list[tuple]] = {}
            for r in pool:
                by_dim.setdefault(len(r[6]), []).append(r)
            pool.clear()
            for rows in by_dim.values():
                x, filters, ids, mult, half = columns(rows)
                bucket, lo, hi = (np.array([r[k] for r in rows], np.int64) for k in range(3))
                number = np.cumsum(np.append(True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
                a, b = _small(x, number, half, lo != hi, bucket, filters, threshold)
                links = np.bincount(a, mult[b], len(rows)) + np.bincount(b, mult[a], len(rows))
                yield answer(a, b, links.astype(np.int64), ids)

        for batch in batches:
            single = (batch.column(c).to_pylist() for c in ("bucket", "lo", "hi", "half", "id", "mult"))
            for row in zip(*single, lists(batch.column("embedding")), lists(batch.column("filters")), strict=True):
                if row[:3] != key:
                    yield from close()
                    key = row[:3]
                    if len(pool) >= 20_000:
                        yield from settle()
                group.append(row)
        yield from close()
        yield from settle()

    return members.mapInArrow(tidy(run), "kind int, a long, b long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, per_vector: int = 24, least: int = 16, block: int = 2048, recall: float = 0.995) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    `per_vector` and `least` are where the search for the width that gives `recall` begins."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    folded = staged(rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")), "vectors")
    n = folded.count()
    q = filters_across(n)
    # an id with several vectors is told apart by a running number that only lives here
    known = staged(filtered(folded.select("id", "mult", "embedding"), q, threshold, recall, per_vector, least).withColumn("key", F.monotonically_increasing_id()), "filters")
    spread = known.select("key", F.explode("filters").alias("bucket"))
    crowd = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    half = F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = spread.join(crowd.hint("merge"), "bucket").withColumn("half", half)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "bucket", F.least("half", "other").alias("lo"), F.greatest("half", "other").alias("hi"), "half")
    members = dealt.join(known.select("key", "mult", "embedding", "filters").hint("merge"), "key").select("bucket", "lo", "hi", "half", F.col("key").alias("id"), "mult", "embedding", F.filter("filters", lambda x: x < F.col("bucket")).alias("filters"))
    parts = max(shuffle_partitions(rows.sparkSession), math.ceil(n / 20_000))
    found = staged(linked(members.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"), threshold), "cap-links")
    roots = components(found.where("kind = 0"))
    counts = found.where("kind = 1").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("links"))
    named = known.select("key", "id", "mult", "embedding").join(counts.hint("merge"), "key", "left").join(roots.select(F.col("node").alias("key"), "root").hint("merge"), "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    # ids that are smallest in a component: keys follow no order of ids
    least_id = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least_id.hint("merge"), "root").select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    done = rows.where("good").join(named.hint("merge"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
