"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node it can reach.

    Each round maps every node's neighbours to the smallest of them; O(log^2 n) rounds. Rounds
    are written tables, joined by merging (none is broadcast on a guess). Only two numbers per
    round come to the driver.
    """
    e = staged(_down(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = _down(both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        met = e.join(low.hint("merge"), "a")
        e = staged(_down(met.select("b", "m").toDF("a", "b").union(low.toDF("a", "b"))), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def _down(e: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
