"""Joins in time: as-of, first-after, overlap, point-in-interval, voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY, ORDER

EPS = 1e-9


def asof_latest(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], slack: float = 0.0) -> DataFrame:
    """For each left row, `values` of the latest right row at or before it (plus `slack`).

    Both sides go through one window over their union: one shuffle by key, no range join. Of
    right rows of one time the one with the largest values stands."""
    extra = [c for c in left.columns if c not in (by, left_time)]
    pack = F.struct(F.col(right_time).alias("_at"), *values)
    a = left.select(F.col(by).alias("_k"), (F.col(left_time) + F.lit(slack) if slack else F.col(left_time)).alias("_t"), F.lit(1).alias("_side"), F.struct(left_time, *extra).alias("_row"), F.lit(None).alias("_val"))
    b = right.select(F.col(by).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), pack.alias("_val"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_val").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_last", F.last("_val", True).over(w)).where("_side = 1")
    return met.select(F.col("_k").alias(by), "_row.*", F.col("_last._at").alias(f"asof_{right_time}"), *(F.col(f"_last.{v}").alias(v) for v in values))


def first_after(anchors: DataFrame, events: DataFrame, at: str, anchor: str = "anchor", keep: list[str] | None = None) -> DataFrame:
    """For each anchor the first event with `at` >= anchor; NULLs where there is none.

    The mirror of asof_latest: one window over the union, in descending order."""
    values = keep or [c for c in events.columns if c != KEY]
    extra = [c for c in anchors.columns if c not in (KEY, anchor)]
    a = anchors.select(KEY, F.col(anchor).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(anchor, *extra).alias("_row"), F.lit(None).alias("_val"))
    b = events.select(KEY, F.col(at).cast("double").alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(*values).alias("_val"))
    w = Window.partitionBy(KEY).orderBy(F.desc("_t"), "_side", F.desc("_val")).rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_next", F.last("_val", True).over(w)).where("_side = 1")
    return met.select(KEY, "_row.*", *(F.col(f"_next.{v}").alias(v) for v in values))


def overlapping(left: DataFrame, right: DataFrame, bucket: float | None = None) -> DataFrame:
    """Pairs of closed intervals of a series that overlap: (series, a, b, other_a, other_b).

    With `bucket`, both sides are cut into buckets of that length and joined on (series,
    bucket), so a long series is many tasks; a pair counts in the bucket where it first meets."""
    r = right.select(KEY, F.col("a").alias("other_a"), F.col("b").alias("other_b"))
    meets = (F.col("a") <= F.col("other_b")) & (F.col("b") >= F.col("other_a"))
    if bucket is None:
        return left.select(KEY, "a", "b").join(r, KEY).where(meets)
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket).cast("long"), F.floor(F.col(b) / bucket).cast("long")))
    met = left.select(KEY, "a", "b", cells("a", "b").alias("_c")).join(r.select("*", cells("other_a", "other_b").alias("_c")), [KEY, "_c"]).where(meets)
    return met.where(F.col("_c") == F.floor(F.greatest("a", "other_a") / bucket)).drop("_c")


def not_overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intervals that overlap none of the others of their series.

    One that begins no later than mine ends overlaps me if the latest end of all such reaches my
    beginning: a running value over the union, no range join."""
    rest = [c for c in left.columns if c not in (KEY, "a", "b")]
    mine = left.select(KEY, F.col("b").alias("_t"), F.lit(1).alias("_s"), F.struct("a", "b", *rest).alias("_row"), F.lit(None).cast(right.schema["b"].dataType).alias("_end"))
    others = right.select(KEY, F.col("a").alias("_t"), F.lit(0).alias("_s"), F.lit(None).alias("_row"), F.col("b").alias("_end"))
    upto = Window.partitionBy(KEY).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = mine.unionByName(others).withColumn("_last", F.max("_end").over(upto)).where("_s = 1")
    return met.where(F.col("_last").isNull() | (F.col("_last") < F.col("_row.a"))).select(KEY, "_row.*").select(*left.columns)


def votes(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Each sample with the summed weight of the spans that hold it.

    Spans become +weight and -weight steps, and a running sum answers every sample: no pairs of
    samples and spans, whatever their number."""
    steps = spans.select(KEY, F.col("a").alias(ORDER), F.lit(0).alias("_o"), F.col("weight").alias("_d")).union(spans.select(KEY, F.col("b"), F.lit(2), -F.col("weight")))
    rows = samples.select(KEY, ORDER, F.lit(1).alias("_o"), F.lit(0).alias("_d")).union(steps)
    w = Window.partitionBy(KEY).orderBy(ORDER, "_o").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("votes", F.sum("_d").over(w)).where("_o = 1").select(KEY, ORDER, "votes")


def near(a: str, b: str, lo: Column, hi: Column, distance: float) -> Column:
    """Is [a, b] at most `distance` from [lo, hi]?"""
    return ~((F.col(a) > hi + distance) | (F.col(b) < lo - distance))


def majority(voted: DataFrame, total: float | Column) -> DataFrame:
    """First run of samples with more than half of `total`; else of those with the most votes (weak)."""
    from .patterns import runs

    top = voted.withColumn("_m", F.max("votes").over(Window.partitionBy(KEY)))
    half = F.lit(total) / 2 if not isinstance(total, Column) else total / 2
    strong, best = runs(top, F.col("votes") > half), runs(top, (F.col("votes") == F.col("_m")) & (F.col("_m") > 0))
    both = strong.withColumn("weak", F.lit(False)).union(best.withColumn("weak", F.lit(True)))
    return both.groupBy(KEY).agg(F.min(F.struct("weak", "a", "b")).alias("_r")).select(KEY, F.col("_r.a").alias("a"), F.col("_r.b").alias("b"), F.col("_r.weak").alias("weak"))


def widened(mode: Column, a: Column, b: Column, centre: Column, half: Column, least: Column, anchor: Column, before_end: Column | None = None) -> tuple[Column, Column]:
    """An event's window: as it is (fixed), +-max(0.75, least) (span) or +-half (centre); never before the anchor."""
    pad = F.greatest(F.lit(0.75), least)
    lo = F.when(mode == "fixed", a).when(mode == "span", a - pad).otherwise(centre - half)
    hi = F.when(mode == "fixed", b).when(mode == "span", b + pad).otherwise(centre + half)
    if before_end is not None:
        hi = F.when(before_end, F.least(hi, b - 1e-3)).otherwise(hi)
    return F.greatest(lo, anchor), hi


def repeats_on_grid(samples: DataFrame, step: float, t: str = "t") -> DataFrame:
    """How many slots of a regular grid of `step` show each sample: those up to the next sample.

    A slot shows the latest sample at or before it, so the counts are differences of places on
    the grid; no slot is ever a row."""
    w = Window.partitionBy(KEY).orderBy(t)
    first = F.min(t).over(Window.partitionBy(KEY))
    place = F.ceil((F.col(t) - first) / step - 1e-6)
    return samples.withColumn("_p", place).withColumn("_q", F.lead("_p").over(w)).select(KEY, t, F.coalesce(F.col("_q") - F.col("_p"), F.lit(1)).cast("long").alias("shown"))


def running(starts: DataFrame, instants: DataFrame, slack: float = 1e-6) -> DataFrame:
    """The phase that runs at each instant (clip, t), and since when."""
    left = instants.withColumnRenamed("clip", KEY)
    right = starts.select(F.col("clip").alias(KEY), F.col("time"), "phase")
    out = asof_latest(left, right, KEY, "t", "time", ["phase"], slack)
    return out.withColumnRenamed(KEY, "clip").withColumn("running_for", F.col("t") - F.col("asof_time"))
