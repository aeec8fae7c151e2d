"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

Each tree gives every vector a string of 63 bits: twelve symbols of four bits (which of eight
random directions the vector leans to or from most), then 15 bits that number its place along one
more direction, so that vectors equal in all symbols are still ordered. A tree is the sorted array
of its strings. A query descends by taking its place in each array, where the longest prefix
matches stand around it, and ascends in all trees in step: the depth goes up by one bit
everywhere until the prefixes of all trees together hold `budget` candidates. These are compared
exactly, in double precision.

Largest inner products are turned into smallest angles by one more dimension: a vector of norm r
in a class of norms up to m becomes (x / m, sqrt(1 - r^2 / m^2)), a query (q / |q|, 0). Classes
are a fourth of an octave wide and have trees of their own, so a few long vectors don't squeeze
the others; a query visits all classes of its length.

The budget is fitted: for `sampled` queries (those of least hash) the exact neighbours are found
by one scan of all vectors, and the smallest budget is taken by which at least `recall` of them
would be reached. All vectors are indexed, all queries searched.

Scale: equal vectors fold into one. Strings, without vectors, are range-partitioned by (tree,
string, key), whatever prefix many share; a place's number in the whole array names its block, so
blocks have equal size, and a block that very many queries visit is given out several times.
Prefix counts need `reach` neighbours on both sides, which a block gets as copies from the next
ones. Each vector is sent once for every tree, each query once for every block that it reads; no
row stands for a pair: a block answers a query by its best k + 1. A tree gives a query at most
`reach` candidates on each side, the nearest in order of strings, which is several times its
share of the budget; what that loses is small (recall is measured in the tests and the README).
The driver sees the sample and one count a partition; only these are broadcast.

Defined results: a vector that is null, empty, zero or has null or non-finite components takes no
part, nor does a row without vec_id; vectors of different lengths never meet; a row repeated with
the same vec_id and vector counts once, and rows of the query's own vec_id are never its
neighbours; rows that share a vec_id but not the vector stand for themselves; equal scores rank by
vec_id; with fewer than k candidates all are returned; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, table, tidy

SYMBOLS, DIRECTIONS, FINE = 12, 8, 15  # 12 symbols of 4 bits and 15 bits: 63
BITS = 63
CLASSES = 20_000  # numbers of norm classes: 4 for each power of two that a double can have
SLACK = 1.001  # the classes' upper ends, so that unit vectors stand just below one


@lru_cache(maxsize=200)
def directions(dim: int, tree: int) -> np.ndarray:
    """A tree's random directions; the same in every process."""
    return np.random.default_rng([dim, tree, 29]).standard_normal((dim + 1, SYMBOLS * DIRECTIONS + 1), dtype=np.float32)


def strings(x: np.ndarray, tree: int) -> np.ndarray:
    """The strings of unit vectors (one dimension more than the rows of the table) in a tree."""
    y = x.astype(np.float32) @ directions(x.shape[1] - 1, tree)
    lean = y[:, :-1].reshape(len(x), SYMBOLS, DIRECTIONS)
    most = np.abs(lean).argmax(axis=2)
    sign = np.take_along_axis(lean, most[:, :, None], 2)[:, :, 0] > 0
    out = np.zeros(len(x), np.int64)
    for k in range(SYMBOLS):
        out = out << 4 | most[:, k] << 1 | sign[:, k]
    place = np.clip((y[:, -1] + 4) / 8 * (1 << FINE), 0, (1 << FINE) - 1)
    return out << FINE | place.astype(np.int64)


def matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, the rows as doubles) for each length of the lists."""
    if not len(column):
        return
    sizes = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, flat.reshape(-1, dim) if len(rows) == len(sizes) else flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the binary logarithms of the norms, without overflow."""
    most = np.abs(x).max(axis=1)
    y = x / most[:, None]
    norm = np.linalg.norm(y, axis=1)
    return y / norm[:, None], np.log2(most) + np.log2(norm)


def point_strings(vectors: DataFrame, trees: int) -> DataFrame:
    """(tree, code, key): a vector's strings, in the trees of its length and norm class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for dim, rows, x in matrices(batch.column("embedding")):
                unit, log = scaled(x)
                number = np.ceil(4 * (log - math.log2(SLACK)))
                r = np.minimum(np.exp2(log - math.log2(SLACK) - number / 4), 1.0)
                unit = np.hstack([unit * r[:, None], np.sqrt(1 - r * r)[:, None]])
                forest = (dim * CLASSES + CLASSES // 2 + number.astype(np.int64)) * trees
                for tree in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(forest + tree), pa.array(strings(unit, tree)), pa.array(keys[rows])], ["tree", "code", "key"])

    return vectors.select("key", "embedding").mapInArrow(tidy(run), "tree long, code long, key long")


def query_strings(queries: DataFrame, trees: int) -> DataFrame:
    """(tree, code, key): a query's strings, in the trees of all classes of its length. queries: key, embedding, forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for _, rows, x in matrices(batch.column("embedding")):
                unit = np.hstack([scaled(x)[0], np.zeros((len(x), 1))])
                forests = batch.column("forests")[int(rows[0])].as_py()  # equal for all of a length
                for tree in range(trees):
                    code = pa.array(strings(unit, tree))
                    for forest in forests:
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(forest * trees + tree, pa.int64()), len(rows)), code, pa.array(keys[rows])], ["tree", "code", "key"])

    return queries.mapInArrow(tidy(run), "tree long, code long, key long")


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings."""
    x = a ^ b
    high = np.frexp((x >> 32).astype(np.float64))[1]
    low = np.frexp((x & 0xFFFFFFFF).astype(np.float64))[1]
    return BITS - np.where(high > 0, high + 32, low)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal keys, together."""
    held: list[pa.RecordBatch] = []
    last = None

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield joined()
                held.clear()
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield joined()


def best_of(scores: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: larger score, then smaller id."""
    if len(scores) > k:
        pick = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((low[pick], -scores[pick]))[:k]]


def fitted_budget(vectors: DataFrame, points: DataFrame, probes: DataFrame, k: int, trees: int, recall: float, sampled: int) -> int:
    """The smallest number of candidates by which the sampled queries reach `recall` of their neighbours."""
    chosen = probes.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sampled)
    sample = {r.key: r.embedding for r in vectors.join(F.broadcast(chosen), "key").select("key", "embedding").collect()}
    if not sample:
        return 1
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(v) for v in sample.values()}:
        of = [key for key, v in sample.items() if len(v) == dim]
        by_dim[dim] = np.array(of, np.int64), np.array([sample[key] for key in of], np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {dim: [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(of) for dim, (of, _) in by_dim.items()}
        for batch in batches:
            keys, low = batch.column("key").to_numpy(), batch.column("low").to_numpy()
            for dim, rows, x in matrices(batch.column("embedding")):
                if dim not in by_dim:
                    continue
                of, q = by_dim[dim]
                for n, scores in enumerate((x @ q.T).T):
                    other = keys[rows] != of[n]
                    all_ = [np.concatenate(z) for z in zip(held[dim][n], (scores[other], low[rows][other], keys[rows][other]), strict=True)]
                    best = best_of(all_[0], all_[1], k)
                    held[dim][n] = tuple(z[best] for z in all_)
        for dim, found in held.items():
            for own, (scores, low, keys) in zip(by_dim[dim][0], found, strict=True):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(int(own), pa.int64()), len(keys)), pa.array(keys), pa.array(scores), pa.array(low)], ["own", "key", "score", "low"])

    each = vectors.select("key", F.col("ids")[0].alias("low"), "embedding").mapInArrow(tidy(scan), "own long, key long, score double, low long")
    best = Window.partitionBy("own").orderBy(F.desc("score"), "low", "key")
    near = staged(each.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("own", "key"), "forest-sample")
    mine = probes.join(F.broadcast(chosen), "key").select(F.col("key").alias("own"), "tree", "code").toArrow()
    theirs = points.join(F.broadcast(near), "key").select("own", "key", "tree", "code").toArrow()

    # how deep in the best of the trees each neighbour is met
    own_codes: dict[int, dict[int, int]] = {}
    for own, tree, code in zip(*(mine.column(c).to_pylist() for c in ("own", "tree", "code")), strict=True):
        own_codes.setdefault(own, {})[tree] = code
    own, key, tree, code = (theirs.column(c).to_numpy() for c in ("own", "key", "tree", "code"))
    met = shared_bits(code, np.array([own_codes[a][b] for a, b in zip(own.tolist(), tree.tolist(), strict=True)], np.int64))
    deepest: dict[tuple[int, int], int] = {}
    for a, b, d in zip(own.tolist(), key.tolist(), met.tolist(), strict=True):
        deepest[a, b] = max(d, deepest.get((a, b), 0))
    if not deepest:
        return 1

    # how many strings share each depth with the sample's, over all trees
    order = sorted(own_codes)
    by_tree: dict[int, tuple[list[int], list[int]]] = {}
    for n, a in enumerate(order):
        for b, c in own_codes[a].items():
            by_tree.setdefault(b, ([], []))
            by_tree[b][0].append(n)
            by_tree[b][1].append(c)
    lines = {b: (np.array(n), np.array(c, np.uint64)) for b, (n, c) in by_tree.items()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(order), BITS + 1), np.int64)
        held: list[pa.RecordBatch] = []

        def add() -> None:
            rows = pa.Table.from_batches(held)
            tree, code = rows.column("tree").to_numpy(), rows.column("code").to_numpy().astype(np.uint64)
            by = np.lexsort((code, tree))
            tree, code = tree[by], code[by]
            starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(tree)), strict=True):
                if int(tree[a]) in lines:
                    n, c = lines[int(tree[a])]
                    lo, hi = prefix_ranges(code[a:b], c)
                    total[n] += hi - lo
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > 1_000_000:
                add()
        if held:
            add()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(order)), BITS + 1)), pa.array(np.tile(np.arange(BITS + 1), len(order))), pa.array(total.ravel())], ["own", "depth", "n"])

    sums = points.select("tree", "code").mapInArrow(tidy(counted), "own long, depth long, n long").groupBy("own", "depth").agg(F.sum("n").alias("n")).toArrow()
    holds = np.zeros((len(order), BITS + 1), np.int64)
    holds[sums.column("own").to_numpy(), sums.column("depth").to_numpy()] = sums.column("n").to_numpy()
    number = {a: n for n, a in enumerate(order)}
    whose = np.array([number[a] for a, _ in deepest])
    depth = np.array(list(deepest.values()))
    budget = trees * (k + 1)
    while budget < holds.max():
        stop = np.maximum((holds >= budget).sum(axis=1) - 1, 0)  # counts fall with the depth
        if (depth >= stop[whose]).mean() >= recall:
            break
        budget = math.ceil(budget * 1.1)
    return budget


def prefix_ranges(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code and depth (rows, columns): where the codes with its first `depth` bits begin and end."""
    lo = np.zeros((len(codes), BITS + 1), np.int64)
    hi = np.full((len(codes), BITS + 1), len(sorted_codes), np.int64)
    for depth in range(1, BITS + 1):
        rest = np.uint64(BITS - depth)
        prefix = codes >> rest
        lo[:, depth] = np.searchsorted(sorted_codes, prefix << rest, "left")
        hi[:, depth] = np.searchsorted(sorted_codes, (prefix + np.uint64(1)) << rest, "left")
    return lo, hi


def placed(points: DataFrame, probes: DataFrame, rows: int) -> DataFrame:
    """(tree, code, key, probe, place): all strings sorted; a point's place among the points, a probe's is that of the next point."""
    spark = points.sparkSession
    both = points.withColumn("probe", F.lit(0)).union(probes.withColumn("probe", F.lit(1)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            point = 1 - batch.column("probe").to_numpy().astype(np.int64)
            upto = before + np.cumsum(point)
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(upto - point)], [*batch.schema.names, "part", "at"])

    parts = max(shuffle_partitions(spark), math.ceil(rows / 1_000_000))
    order = ["tree", "code", "probe", "key"]
    numbered = both.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(number), "tree long, code long, key long, probe int, part long, at long")
    numbered = staged(numbered, "forest-sorted")
    counts = {r.part: r.n for r in numbered.where("probe = 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, start = [], 0
    for part in range(max(counts, default=0) + 1 + parts):  # parts without points come in between
        first.append((part, start))
        start += counts.get(part, 0)
    starts = spark.createDataFrame(first, "part long, start long")  # a row for each partition
    return numbered.join(F.broadcast(starts), "part").select("tree", "code", "key", "probe", (F.col("start") + F.col("at")).alias("place"))


def dealt(points: DataFrame, probes: DataFrame, most: int, parts: int) -> DataFrame:
    """Both by block, points first, each in order of place; a block with more than `most` probes is given out several times."""
    heavy = staged(probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("ways")).where("ways > 1"), "forest-heavy")
    if heavy.limit(1).count():
        ways = F.coalesce(F.col("ways"), F.lit(1).cast("long"))
        probes = probes.join(heavy.hint("merge"), "block", "left").withColumn("way", F.pmod(F.xxhash64("key", "place"), ways)).drop("ways")
        points = points.join(heavy.hint("merge"), "block", "left").withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1))).drop("ways")
    else:
        probes, points = (x.withColumn("way", F.lit(0).cast("long")) for x in (probes, points))
    return points.unionByName(probes, allowMissingColumns=True).repartition(parts, "block", "way").sortWithinPartitions("block", "way", "probe", "place")


def profiles(sorted_: DataFrame, reach: int, parts: int, most: int) -> DataFrame:
    """(key, tree, place, before, behind): how many points before and behind a probe share each depth with it, `reach` at most."""
    block = 4 * reach
    own = (F.col("place") / block).cast("long")
    inside = F.pmod("place", F.lit(block))
    near = F.array_compact(F.array(own, F.when((inside < reach) & (own > 0), own - 1), F.when(inside >= block - reach, own + 1)))
    points = sorted_.where("probe = 0").withColumn("block", F.explode(near))
    probes = sorted_.where("probe = 1").withColumn("block", own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["block", "way"]):
            split = group.num_rows - int(group.column("probe").to_numpy().sum())
            tree, code, place = (group.column(c).to_numpy() for c in ("tree", "code", "place"))
            begin = int(place[0]) if split else 0
            asked = tree[split:]
            for t in np.unique(asked):
                rows = split + np.flatnonzero(asked == t)
                a, b = np.searchsorted(tree[:split], [t, t + 1])
                lo, hi = prefix_ranges(code[a:b].astype(np.uint64), code[rows].astype(np.uint64))
                at = (place[rows] - begin - a)[:, None]  # may lie outside where the tree has no points here
                at = np.clip(at, 0, b - a)
                before = np.minimum(np.maximum(at - lo, 0), reach)
                behind = np.minimum(np.maximum(hi - at, 0), reach)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, BITS + 1, dtype=np.int32)), pa.array(x.ravel().astype(np.int32))) for x in (before, behind)]
                yield pa.RecordBatch.from_arrays([group.column("key").take(pa.array(rows)), pa.array(tree[rows]), pa.array(place[rows]), *lists], ["key", "tree", "place", "before", "behind"])

    met = dealt(points, probes, most, parts)
    return met.mapInArrow(tidy(run), "key long, tree long, place long, before array<int>, behind array<int>")


def windows(profile: DataFrame, budget: int, k: int, parts: int) -> DataFrame:
    """(key, lo, hi): the places to read for a query, after ascending in step in all its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key"]):
            before, behind = (group.column(c).flatten().to_numpy().reshape(-1, BITS + 1) for c in ("before", "behind"))
            total = (before + behind).sum(axis=0, dtype=np.int64)
            # k + 1 for each tree, so that one of them has so many at least
            stop = max(int((total >= max(budget, (k + 1) * len(before))).sum()) - 1, 0)
            place = group.column("place").to_numpy()
            lo, hi = place - before[:, stop], place + behind[:, stop]
            some = np.flatnonzero(hi > lo)
            yield pa.RecordBatch.from_arrays([group.column("key").take(pa.array(some)), pa.array(lo[some]), pa.array(hi[some])], ["key", "lo", "hi"])

    return profile.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(run), "key long, lo long, hi long")


def compared(sorted_: DataFrame, asked: DataFrame, vectors: DataFrame, k: int, block: int, parts: int, most: int) -> DataFrame:
    """(own, keys, lows, scores): the best of each window's part in a block."""
    owned = vectors.select("key", F.col("ids")[0].alias("low"), "embedding")
    none = F.lit(0).cast("long")
    points = sorted_.where("probe = 0").select("key", "place").join(owned.hint("merge"), "key")
    points = points.select((F.col("place") / block).cast("long").alias("block"), F.lit(0).alias("probe"), "place", none.alias("hi"), "key", "low", "embedding")
    probes = asked.join(owned.select("key", "embedding").hint("merge"), "key")
    probes = probes.withColumn("block", F.explode(F.sequence((F.col("lo") / block).cast("long"), ((F.col("hi") - 1) / block).cast("long"))))
    probes = probes.select("block", F.lit(1).alias("probe"), F.col("lo").alias("place"), "hi", "key", none.alias("low"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["block", "way"]):
            split = group.num_rows - int(group.column("probe").to_numpy().sum())
            key, low, place, hi = (group.column(c).to_numpy() for c in ("key", "low", "place", "hi"))
            found: list[tuple] = []
            for _, rows, x in matrices(group.column("embedding")):
                cut = int(np.searchsorted(rows, split))
                here = place[rows[:cut]]
                for n in range(cut, len(rows)):
                    r = rows[n]
                    a, b = np.searchsorted(here, [place[r], hi[r]])
                    if a < b:
                        scores = x[a:b] @ x[n]
                        best = best_of(scores, low[rows[a:b]], k)
                        found.append((key[r], key[rows[a:b]][best], low[rows[a:b]][best], scores[best]))
            if found:
                ends = pa.array(np.append(0, np.cumsum([len(f[1]) for f in found])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[c] for f in found]))) for c in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([f[0] for f in found], np.int64)), *lists], ["own", "keys", "lows", "scores"])

    return dealt(points, probes, most, parts).mapInArrow(tidy(run), "own long, keys array<long>, lows array<long>, scores array<double>")


def merged(answers: DataFrame, k: int, parts: int) -> DataFrame:
    """(own, key): the k best of a query's answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["own"]):
            keys, lows, scores = (group.column(c).flatten().to_numpy() for c in ("keys", "lows", "scores"))
            keys, first = np.unique(keys, return_index=True)
            best = best_of(scores[first], lows[first], k)
            yield pa.RecordBatch.from_arrays([pa.repeat(group.column("own")[0], len(best)), pa.array(keys[best])], ["own", "key"])

    return answers.repartition(parts, "own").sortWithinPartitions("own").mapInArrow(tidy(run), "own long, key long")


def nearest(vectors: DataFrame, asked: Column | None = None, k: int = 20, trees: int = 40, recall: float = 0.97, sampled: int = 128, block: int = 2048, most: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which `asked` holds (vec_id divisible by 20)."""
    spark = vectors.sparkSession
    asked = F.pmod("vec_id", F.lit(20)) == 0 if asked is None else asked
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = staged(rows.groupBy("vec_id", "embedding").agg(F.first(F.lit(1)).alias("one")).drop("one"), "forest-rows")
    least = Window.partitionBy("embedding").orderBy("vec_id")
    folded = rows.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    folded = staged(folded.withColumn("key", F.monotonically_increasing_id()), "forest-vectors")
    queries = staged(rows.where(asked).join(folded.select("embedding", "key").hint("merge"), "embedding").select(F.col("vec_id").alias("query_id"), "key"), "forest-queries")

    points = staged(point_strings(folded, trees), "forest-points")
    forests = points.select((F.col("tree") / trees).cast("long").alias("forest")).distinct().groupBy((F.col("forest") / CLASSES).cast("long").alias("dim")).agg(F.sort_array(F.collect_list("forest")).alias("forests"))
    own = queries.select("key").distinct().join(folded.select("key", "embedding", F.size("embedding").cast("long").alias("dim")).hint("merge"), "key")
    probes = staged(query_strings(own.join(forests.hint("merge"), "dim").select("key", "embedding", "forests"), trees), "forest-probes")
    budget = fitted_budget(folded, points, probes, k, trees, recall, sampled)
    reach = max(512, math.ceil(6 * budget / trees))

    n = points.count()
    parts = max(shuffle_partitions(spark), math.ceil(n / 200_000))
    sorted_ = staged(placed(points, probes, n + probes.count()), "forest-places")
    asked_ = staged(windows(profiles(sorted_, reach, parts, most), budget, k, parts), "forest-windows")
    answers = staged(compared(sorted_, asked_, folded, k + 1, block, parts, most), "forest-answers")
    found = merged(answers, k + 1, parts)

    # exact scores, in the order of the components
    mine = folded.select(F.col("key").alias("own"), F.col("embedding").alias("query"))
    both = found.join(folded.select("key", "ids", "embedding").hint("merge"), "key").join(mine.hint("merge"), "own")
    product = F.zip_with("query", "embedding", lambda a, b: a.cast("double") * b.cast("double"))
    scored = both.select("own", "ids", F.aggregate(product, F.lit(0.0), lambda s, x: s + x).alias("score"))
    listed = scored.select("own", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))).alias("x"))
    listed = listed.groupBy("own").agg(F.slice(F.sort_array(F.collect_list("x")), 1, k + 1).alias("all"))
    out = queries.join(listed.withColumnRenamed("own", "key").hint("merge"), "key")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("x.less")).alias("score"))


def op11_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
