"""Nearest neighbours by the forest against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import forest
from cadence.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    """query_id -> [(score, vec_id)], best first; rows of one id stand for themselves."""
    good = sorted({(i, tuple(np.float32(v).item() for v in e)) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)})
    out = {}
    for i, e in good:
        if i % every == 0:
            q = np.array(e)
            same = [(float(-(q * np.array(x)).sum()), j) for j, x in good if j != i and len(x) == len(e)]
            out.setdefault(i, []).append([(-s, j) for s, j in sorted(same)[:k]])
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    return out


def checked(got, want, exact_of):
    """Ranks run on, order and scores are right; gives the recall."""
    hit = total = 0
    for q, lists in want.items():
        (best,) = lists
        mine = got.get(q, [])
        assert [r for *_, r in mine] == list(range(1, len(best) + 1))
        assert all(abs(s - exact_of(q, j)) <= 1e-12 * max(1, abs(s)) for s, j, _ in mine)
        assert mine == sorted(mine, key=lambda x: (-x[0], x[1]))
        hit += len({j for _, j, _ in mine} & {j for _, j in best})
        total += len(best)
    assert set(got) <= set(want)
    return hit / total


def rows_of(x, start=0):
    return [(start + n, v.tolist()) for n, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "norms"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 48))
    if kind == "clusters":  # a third of all rows are near copies of one vector, others stand in groups
        x[:500] = x[0] + 0.02 * rng.standard_normal((500, 48))
        x[500:1000] = x[500:1000] * 0.2 + np.repeat(x[1000:1050], 10, axis=0)
    if kind == "norms":
        x *= np.exp(rng.standard_normal(1500))[:, None]
        x[7] *= 1e6
    else:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = rows_of(rng.permutation(x))
    at = {i: np.array(e) for i, e in rows}
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    want = brute(rows)
    assert checked(answers(forest.nearest(df)), want, lambda a, b: (at[a] * at[b]).sum()) >= 0.9


def test_copies_ties_and_what_takes_no_part(spark):
    rng = np.random.default_rng(6)
    same = [3.0, 0.0, 4.0, 0.0]
    rows = [(n, same) for n in range(300)]  # a hot vector: many queries, equal scores
    rows += [(300 + n, [float(v) for v in rng.integers(-2, 3, 4)]) for n in range(200)]
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (1002, [0.0, 0.0]), (1020, [1.0]), (1040, None), (1060, []), (1080, [1.0, None]), (1100, [float("nan"), 1.0]), (1120, [float("inf"), 1.0]), (None, [1.0, 2.0])]
    rows += [(0, same), (0, same), (305, [0.0, 1.0, 0.0, 0.0])]  # repeated rows; an id with two vectors
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    got = answers(forest.nearest(df.withColumn("score", F.lit(1)).withColumn("key", F.lit(2)).withColumn("rank", F.lit(3)).drop("label")))
    want = {q: lists[0] for q, lists in brute(rows).items() if len(lists) == 1}
    assert {q: [(s, j) for s, j, _ in mine] for q, mine in got.items()} == {q: best for q, best in want.items() if best}
    assert len(got[1000]) == 1 and 1020 not in got and 1040 not in got


def test_blocks_given_out_several_times_give_the_same(spark):
    rng = np.random.default_rng(7)
    rows = rows_of(rng.standard_normal((300, 12)))
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    whole = answers(forest.nearest(df, asked=F.col("vec_id") % 5 == 0))
    assert answers(forest.nearest(df, asked=F.col("vec_id") % 5 == 0, most=7, block=100)) == whole


def test_doubles_and_empty_table(spark):
    rows = [(20 * n, [1e150 * n, 1.0]) for n in range(1, 4)] + [(7, [1e-200, 0.0])]
    got = answers(forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [j for _, j, _ in got[20]] == [60, 40, 7]
    assert forest.nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_over_the_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    at = {i: np.array(e) for i, e in rows}
    got = answers(QUERIES["op11_hash_forest"](spark, path))
    assert checked(got, brute(rows), lambda a, b: (at[a] * at[b]).sum()) >= 0.9
