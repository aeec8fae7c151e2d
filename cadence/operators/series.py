"""Window operators over regular series (series, i, v): smoothing, rates, noise, trends.

All of them share one partitioning and ordering, so a chain costs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush, heappushpop

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import WindowSpec

KEY, ORDER = "series", "i"


def along(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def window_samples(seconds: float, dt: float) -> int:
    """Seconds as a number of samples, rounded half to even, at least one."""
    return max(1, round(seconds / dt))


def frame(width: int, align: str) -> tuple[int, int]:
    """Row bounds of a window of `width` samples."""
    before = (width - 1) // 2
    return {"trailing": (1 - width, 0), "leading": (0, width - 1), "centred": (-before, width - 1 - before)}[align]


def moving_average(v: str, width: int, align: str = "trailing", min_fraction: float = 0.5) -> Column:
    """Mean of the measured samples of the window; NULL if fewer than half (of it, or of what is there)."""
    if width <= 1:
        return F.col(v)
    w = along().rowsBetween(*frame(width, align))
    need = F.least(F.lit(-(-width * min_fraction // 1)), F.count(F.lit(1)).over(w))
    return F.when(F.count(v).over(w) >= need, F.avg(v).over(w))


def interpolated(v: str) -> Column:
    """Gaps filled on a straight line by sample number; ends stay open."""
    # what lies ahead is what lies behind in descending order: a running value, linear in the series
    behind = Window.partitionBy(KEY).orderBy(F.col(ORDER).desc())
    back, ahead = along().rowsBetween(Window.unboundedPreceding, 0), behind.rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(v).isNotNull(), F.col(ORDER))
    i0, v0 = F.last(at, True).over(back), F.last(v, True).over(back)
    i1, v1 = F.last(at, True).over(ahead), F.last(v, True).over(ahead)
    return F.when(i1 == i0, F.col(v)).otherwise(v0 + (v1 - v0) * F.try_divide(F.col(ORDER) - i0, i1 - i0))


def derivative(df: DataFrame, v: str, out: str, half: int, dt: float = 1.0) -> DataFrame:
    """Savitzky-Golay first derivative of order 2 over 2 * half + 1 samples.

    Inside it equals the slope of the least-squares line; the first and last `half` samples come
    from the quadratic through the first or last full window. Interior gaps are interpolated,
    open ends count as 0 in the fit and are blank in the result; a series of at most one window
    has no derivative.
    """
    width = 2 * half + 1
    whole = Window.partitionBy(KEY)
    m2 = half * (half + 1) / 3.0
    sq = float(sum(k * k for k in range(-half, half + 1)))
    quart = float(sum((k * k - m2) ** 2 for k in range(-half, half + 1)))
    df = df.withColumn("_f", interpolated(v)).withColumn("_z", F.coalesce("_f", F.lit(0.0))).withColumn("_n", F.count(F.lit(1)).over(whole))
    df = df.withColumn("_r", F.row_number().over(along()) - 1)
    slope = F.regr_slope("_z", F.col(ORDER) * F.lit(dt)).over(along().rowsBetween(-half, half))
    k_head, k_tail = F.col("_r") - half, F.col("_r") - (F.col("_n") - 1 - half)

    def fit(k: Column) -> tuple[Column, Column]:
        inside = k.between(-half, half)
        return F.sum(F.when(inside, k * F.col("_z"))).over(whole) / sq, F.sum(F.when(inside, (k * k - m2) * F.col("_z"))).over(whole) / quart

    (a1, a2), (b1, b2) = fit(k_head), fit(k_tail)
    at = F.when(F.col("_r") < half, (a1 + 2 * a2 * k_head) / dt).when(F.col("_r") > F.col("_n") - 1 - half, (b1 + 2 * b2 * k_tail) / dt).otherwise(slope)
    return df.withColumn(out, F.when((F.col("_n") > width) & F.col("_f").isNotNull(), at)).drop("_f", "_z", "_n", "_r")


def gradient(v: str, t: str = ORDER) -> Column:
    """Second-order differences on uneven spacing, first-order at the ends."""
    w = along()
    x0, x1, x2 = F.lag(v).over(w), F.col(v), F.lead(v).over(w)
    a, b = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    inner = (a * a * x2 + (b * b - a * a) * x1 - b * b * x0) / (a * b * (a + b))
    return F.when(a.isNull(), (x2 - x1) / b).when(b.isNull(), (x1 - x0) / a).otherwise(inner)


def noise_scale(df: DataFrame, v: str = "v") -> DataFrame:
    """Per series: 1.4826 / sqrt(2) times the median absolute deviation of successive differences."""
    w = along()
    d = df.where(F.col(v).isNotNull()).withColumn("_d", F.col(v) - F.lag(v).over(w))
    mid = d.groupBy(KEY).agg(F.median("_d").alias("_m"), F.count(F.lit(1)).alias("_n"))
    out = d.join(mid, KEY).groupBy(KEY).agg(F.median(F.abs(F.col("_d") - F.col("_m"))).alias("_mad"), F.max("_n").alias("_n"))
    return out.select(KEY, F.when(F.col("_n") >= 3, F.col("_mad") * 1.4826 / F.sqrt(F.lit(2.0))).alias("noise"))


def spread(v: str = "v") -> Column:
    """p95 - p5, or 1 where that is 0 (an aggregate)."""
    s = F.percentile(v, F.lit(0.95)) - F.percentile(v, F.lit(0.05))
    return F.when(s > 0, s).otherwise(F.lit(1.0))


def with_spread(df: DataFrame, v: str = "v") -> DataFrame:
    return df.join(df.groupBy(KEY).agg(spread(v).alias("spread")), KEY)


def side_changes(df: DataFrame, v: str, samples: int) -> DataFrame:
    """`before` and `after`: the trend over `samples` steps on either side, in spreads.

    NULL where the frame leaves the series or holds a gap. df needs `spread`."""
    def trend(a: int, b: int) -> Column:
        w = along().rowsBetween(a, b)
        return F.when(F.count(v).over(w) == samples + 1, F.regr_slope(v, F.col(ORDER).cast("double")).over(w) * samples / F.col("spread"))

    return df.withColumn("before", trend(-samples, 0)).withColumn("after", trend(0, samples))


def expanding_median(df: DataFrame, v: str = "v", out: str = "past") -> DataFrame:
    """Adds the median of the past, without the current sample.

    Two heaps per series, fed in order as sorted batches stream by: n log n in a series, and no
    series is held whole (the heaps keep its numbers only)."""
    rows = df.repartition(KEY).sortWithinPartitions(KEY, ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, low, high = None, [], []
        for batch in batches:
            medians = []
            for key, x in zip(batch.column(KEY).to_pylist(), batch.column(v).to_pylist(), strict=True):
                if key != at:
                    at, low, high = key, [], []
                medians.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
                if x is not None:
                    heappush(high, -heappushpop(low, -x))
                    if len(high) > len(low):
                        heappush(low, -heappop(high))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(medians, pa.float64())], [*batch.schema.names, out])

    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def persists(hit: Column, samples: int) -> Column:
    """True while `hit` stays true for the next `samples` samples, all of which are there."""
    w = along().rowsBetween(0, samples)
    return (F.count(F.lit(1)).over(w) == samples + 1) & (F.min(F.coalesce(hit, F.lit(False)).cast("int")).over(w) == 1)


def held(v: str) -> Column:
    """The last measured value so far."""
    return F.last(v, True).over(along().rowsBetween(Window.unboundedPreceding, 0))


def timeline(df: DataFrame, t: str = ORDER, tolerance: float = 0.002) -> DataFrame:
    """Per series: median spacing and whether the clock is constant or variable."""
    d = df.withColumn("_d", (F.col(t) - F.lag(t).over(along())).cast("double"))
    out = d.groupBy(KEY).agg(F.median("_d").alias("spacing"), (F.max("_d") - F.min("_d")).alias("_range"), F.count(F.lit(1)).alias("samples"))
    return out.select(KEY, "samples", "spacing", F.when(F.try_divide("_range", "spacing") <= tolerance, F.lit("constant")).otherwise(F.lit("variable")).alias("timeline"))


def theil_sen(df: DataFrame, v: str, samples: int) -> DataFrame:
    """`slope`: the median of all pairwise slopes in the `samples` steps before each sample.

    Works on the window's own array, so the pairs are never rows."""
    w = along().rowsBetween(-samples, 0)
    df = df.withColumn("_a", F.collect_list(v).over(w))
    slopes = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda k: F.transform(F.sequence(F.lit(1), F.lit(samples + 1) - k), lambda a: (F.element_at("_a", (a + k).cast("int")) - F.element_at("_a", a.cast("int"))) / k)))
    ranked = F.when(F.size("_a") == samples + 1, F.array_sort(slopes))
    n = samples * (samples + 1) // 2
    pick = [n // 2] if n % 2 else [n // 2 - 1, n // 2]
    median = reduce(lambda a, b: a + b, [F.get(ranked, F.lit(k)) for k in pick]) / len(pick)
    return df.withColumn("slope", median).drop("_a")


def scaled(v: str) -> Column:
    """0 at the series' least value, 1 at its greatest; NULL where they are equal."""
    whole = Window.partitionBy(KEY)
    lo, hi = F.min(v).over(whole), F.max(v).over(whole)
    return F.try_divide(F.col(v) - lo, F.nullif(hi - lo, F.lit(0.0)))


def probe(df: DataFrame, rate_hz: float, t: str = "t") -> DataFrame:
    """Frames, duration (last time plus a median step), frames a second, stride and the true rate."""
    steps = df.withColumn("_d", F.col(t) - F.lag(t).over(Window.partitionBy(KEY).orderBy(t)))
    out = steps.groupBy(KEY).agg(F.count("*").alias("frames"), (F.max(t) - F.min(t) + F.median("_d")).alias("duration"))
    out = out.withColumn("fps", F.try_divide("frames", "duration"))
    out = out.withColumn("stride", F.greatest(F.lit(1), F.bround(F.col("fps") / rate_hz)).cast("long"))
    return out.withColumn("actual_rate", F.col("fps") / F.col("stride"))


def clock(sample_time: Column, sample_frame_time: Column, frame_time: Column) -> Column:
    """A frame's time on the samples' clock."""
    return sample_time + (frame_time - sample_frame_time)


def decoupled(df: DataFrame, v: str, every: int, out: str) -> DataFrame:
    """Adds what a slower instrument sees of `v`: every `every`-th sample, NULL in between."""
    return df.withColumn(out, F.when(F.col(ORDER) % every == 0, F.col(v)))


def spacing(df: DataFrame, t: str = "t", tolerance: float = 0.05) -> DataFrame:
    """(series, spacing, spread, uniform, error): the median distance in time, and how far distances range around it.

    A series whose times do not increase, or with a single sample, has an error and no spacing."""
    gap = (F.col(t) - F.lag(t).over(along())).cast("double")
    out = df.withColumn("_d", gap).groupBy(KEY).agg(F.median("_d").alias("m"), (F.max("_d") - F.min("_d")).alias("range"), F.count(F.lit(1)).alias("n"))
    error = F.when(F.col("n") < 2, "fewer than two samples").when(F.col("m").isNull() | ~(F.col("m") > 0), "times do not increase")
    good = error.isNull()
    spread = F.when(good, F.try_divide("range", "m"))
    return out.select(KEY, F.when(good, F.col("m")).alias("spacing"), spread.alias("spread"), (spread <= tolerance).alias("uniform"), error.alias("error"))
