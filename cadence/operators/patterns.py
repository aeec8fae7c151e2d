"""Pattern operators: runs, drops, knees, excursions, shapes, stretches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import Least, next_higher
from .series import KEY, ORDER, along, gradient

#: The nine shapes: trend before x trend after.
WORDS = ("falling", "flat", "rising")
FLAT = 0.08


def runs(df: DataFrame, hit: Column, order: str = ORDER, key: str = KEY) -> DataFrame:
    """Maximal stretches where `hit` is true: (series, a, b, n). A NULL is not a hit."""
    rows = df.select(key, order, F.coalesce(hit, F.lit(False)).alias("_hit"))
    w = Window.partitionBy(key).orderBy(order)
    grp = F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "_hit").orderBy(order))
    return rows.withColumn("_grp", grp).where("_hit").groupBy(key, "_grp").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count(F.lit(1)).alias("n")).drop("_grp")


def runs_within(df: DataFrame, hit: Column, bounds: DataFrame) -> DataFrame:
    """Runs that touch their series' [first, last], whole; bounds: one row per series."""
    return runs(df, hit).join(bounds.select(KEY, "first", "last"), KEY).where((F.col("b") >= F.col("first")) & (F.col("a") <= F.col("last"))).select(KEY, "a", "b", "n")


def lost_spans(df: DataFrame, missing: Column, least: float, step: float = 1.0) -> DataFrame:
    """Stretches of missing samples that last at least `least`."""
    return runs(df, missing).where((F.col("b") - F.col("a")) * step + step >= least)


def big_drops(df: DataFrame, v: str = "v", rest: float = 0.1, least: float = 0.5, longest: float = 25.0) -> DataFrame:
    """Falls of at least `least` spreads within `longest` steps: onset, steepest, bottom, drop.

    A fall is a run of slope below -rest spreads a step; its steepest sample is its first local
    minimum of the slope. df needs `spread`."""
    w = along()
    s = df.withColumn("_s", gradient(v)).withColumn("_l", F.lag("_s").over(w)).withColumn("_r", F.lead("_s").over(w))
    s = s.withColumn("_fall", F.coalesce(F.col("_s") < -rest * F.col("spread"), F.lit(False)))
    s = s.withColumn("_grp", F.row_number().over(w) - F.row_number().over(Window.partitionBy(KEY, "_fall").orderBy(ORDER)))
    low = F.coalesce((F.col("_s") <= F.col("_l")) & (F.col("_s") <= F.col("_r")), F.lit(False))
    out = s.where("_fall").groupBy(KEY, "_grp").agg(
        F.min(ORDER).alias("onset"), F.max(ORDER).alias("bottom"), F.min(F.when(low, F.col(ORDER))).alias("steepest"),
        (F.min_by(v, ORDER) - F.max_by(v, ORDER)).alias("drop"), F.max("spread").alias("spread"),
    )
    return out.where(F.col("steepest").isNotNull() & (F.col("drop") >= least * F.col("spread")) & (F.col("bottom") - F.col("onset") <= longest)).select(KEY, "onset", "steepest", "bottom", "drop")


def drop_hits(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """Every sample (series, i), with `hit` where a drop sets on."""
    onsets = drops.select(KEY, F.col("onset").alias(ORDER), F.lit(True).alias("hit")).distinct()
    return rows.select(KEY, ORDER).join(onsets, [KEY, ORDER], "left").select(KEY, ORDER, F.coalesce("hit", F.lit(False)).alias("hit"))


def one_of_each_start(*spans: DataFrame) -> DataFrame:
    """Stretches of several kinds; of those that begin together the longest."""
    both = spans[0].select(KEY, "a", "b")
    for other in spans[1:]:
        both = both.union(other.select(KEY, "a", "b"))
    return both.groupBy(KEY, "a").agg(F.max("b").alias("b"))


def knee(direction: str, turn: str = "take-off", flat: float = FLAT, steep: float = 0.25) -> Column:
    """Flat, then steep (take-off), or steep, then flat (landing). Needs `before` and `after`."""
    sign = 1 if direction == "rising" else -1
    calm, fast = ("before", "after") if turn == "take-off" else ("after", "before")
    return (F.abs(F.col(calm)) < flat) & (F.col(fast) * sign >= steep)


def dip_then_rise(flat: float = FLAT, rise: float = 0.25) -> Column:
    return (F.col("before") < flat) & (F.col("after") >= rise)


def word(trend: Column, flat: float = FLAT) -> Column:
    return F.when(trend > flat, "rising").when(trend < -flat, "falling").when(trend.isNotNull(), "flat")


def shape(steeper: float = 1.5) -> tuple[Column, Column]:
    """(shape, detail) of a sample from `before` and `after`; NULL where a side is."""
    a, b = word(F.col("before")), word(F.col("after"))
    name = F.concat(a, F.lit(" then "), b)
    ratio = F.try_divide(F.abs("after"), F.abs("before"))
    detail = F.when((a == b) & (a != "flat"), F.when(ratio > steeper, "speeds up").when(ratio < 1 / steeper, "slows down").otherwise("")).when(name.isNotNull(), "")
    return name, detail


def tops(v: np.ndarray) -> np.ndarray:
    """Local maxima; a plateau counts once, at its middle."""
    v = np.asarray(v, np.float64)
    if len(v) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))  # where runs of equal values begin
    last = np.append(first[1:], len(v)) - 1
    level = v[first]
    inner = np.zeros(len(first), bool)
    inner[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (first[inner] + last[inner]) // 2


def peaks(v: np.ndarray, prominence: float) -> list[tuple[int, float, int, int]]:
    """(peak, prominence, left base, right base) of the local maxima that stand out far enough.

    A base is the lowest sample up to the next higher one, the nearest of equals. A stack of
    falling values finds the higher ones, a table of minima the bases: n log n in a series."""
    v = np.asarray(v, np.float64)
    top = tops(v)
    if not len(top):
        return []
    before, behind = next_higher(v)
    left = Least(v, last=True).at(before[top] + 1, top)
    right = Least(v).at(top, behind[top] - 1)
    rise = v[top] - np.maximum(v[left], v[right])
    return [(int(t), float(r), int(a), int(b)) for t, r, a, b in zip(top, rise, left, right, strict=True) if r >= prominence]


def widths(v: np.ndarray, found: list[tuple[int, float, int, int]], share: float = 0.5) -> list[tuple[float, float, float]]:
    """(width, left, right) of each peak at `share` of its prominence below the top, between samples on straight lines.

    A side ends at its base if the level is not reached before."""
    v = np.asarray(v, np.float64)
    out = []
    for top, rise, left, right in found:
        level = v[top] - rise * share
        below = np.flatnonzero(v[left : top + 1][::-1] <= level)
        a = top - int(below[0]) if len(below) else left
        below = np.flatnonzero(v[top : right + 1] <= level)
        b = top + int(below[0]) if len(below) else right
        at_a = a + (level - v[a]) / (v[a + 1] - v[a]) if v[a] < level else float(a)
        at_b = b - (level - v[b]) / (v[b - 1] - v[b]) if v[b] < level else float(b)
        out.append((at_b - at_a, at_a, at_b))
    return out


def excursions(df: DataFrame, v: str = "v", direction: str = "peak", least: float = 0.5) -> DataFrame:
    """Peaks (or dips) of a prominence of `least` spreads: start, apex, finish by strict descent.

    A peak's bases depend on all samples up to the next higher one, so a series is one group of
    a grouped Pandas function; its work is n log n. df needs `spread`; rows without v are left out."""
    sign = 1.0 if direction == "peak" else -1.0

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        x, at = sign * pdf["v"].to_numpy(), pdf[ORDER].to_numpy()
        found = peaks(x, least * float(pdf["spread"].iloc[0]))
        top = np.array([p[0] for p in found], np.int64)
        # a flank runs on while it falls strictly: to where the next step does not
        up, down = np.append(True, ~(x[:-1] < x[1:])), np.append(~(x[1:] < x[:-1]), True)
        begins, ends = np.flatnonzero(up), np.flatnonzero(down)
        a = begins[np.searchsorted(begins, top, "right") - 1] if len(top) else top
        b = ends[np.searchsorted(ends, top, "left")] if len(top) else top
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "start": at[a], "apex": at[top], "finish": at[b], "prominence": [p[1] for p in found]}, columns=[KEY, "start", "apex", "finish", "prominence"])

    return df.where(F.col(v).isNotNull()).select(KEY, ORDER, F.col(v).alias("v"), "spread").groupBy(KEY).applyInPandas(find, f"{KEY} string, start long, apex long, finish long, prominence double")


def wide_peaks(df: DataFrame, v: str = "v", least: float = 0.15, width: float = 0.0, share: float = 0.5) -> DataFrame:
    """(series, top, prominence, left_base, right_base, width, left, right): tops of `least` spreads that are wide enough.

    Widths are in samples, at `share` of the prominence. df needs `spread`; rows without v are left out."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        x, at = pdf["v"].to_numpy(), pdf[ORDER].to_numpy()
        found = peaks(x, least * float(pdf["spread"].iloc[0]))
        rows = [(pdf[KEY].iloc[0], at[t], rise, at[a], at[b], w, lo, hi) for (t, rise, a, b), (w, lo, hi) in zip(found, widths(x, found, share), strict=True) if w >= width]
        return pd.DataFrame(rows, columns=[KEY, "top", "prominence", "left_base", "right_base", "width", "left", "right"])

    return df.where(F.col(v).isNotNull()).select(KEY, ORDER, F.col(v).alias("v"), "spread").groupBy(KEY).applyInPandas(find, f"{KEY} string, top long, prominence double, left_base long, right_base long, width double, left double, right double")


def settle_windows(df: DataFrame, v: str = "v", direction: str = "dip", least: float = 0.5, recovered: float = 0.8, flat: float = FLAT) -> DataFrame:
    """(series, context_a, context_b, a, b): after each dip (or peak), from `recovered` of the way back to where it lies flat.

    The way back is measured to the level the excursion returns to, so the sample that has come
    far enough stands on its trailing flank; flanks of a series never overlap, so each sample is
    held against one level only. The next flat sample is a running value from the far end.
    df needs `spread` and `after`; rows without v are left out."""
    sign = 1.0 if direction == "peak" else -1.0
    rows = df.where(F.col(v).isNotNull()).select(KEY, ORDER, (F.col(v) * sign).alias("x"), (F.abs("after") < flat).alias("calm"))
    found = excursions(df, v, direction, least)
    back = Window.partitionBy(KEY).orderBy(F.col(ORDER).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("settled", F.coalesce(F.last(F.when(F.col("calm"), F.col(ORDER)), True).over(back), F.max(ORDER).over(Window.partitionBy(KEY))))
    ends = rows.select(KEY, F.col(ORDER).alias("finish"), F.col("x").alias("bottom"))
    marks = found.join(ends, [KEY, "finish"]).select(KEY, F.col("apex").alias(ORDER), F.struct("start", "apex", "finish", "bottom").alias("of"))
    behind = along().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flank = rows.join(marks, [KEY, ORDER], "left").withColumn("top", F.last(F.when(F.col("of").isNotNull(), F.col("x")), True).over(behind)).withColumn("of", F.last("of", True).over(behind))
    level = F.col("of.bottom") + (1 - recovered) * (F.col("top") - F.col("of.bottom"))
    there = flank.where((F.col(ORDER) <= F.col("of.finish")) & (F.col("x") <= level))
    first = there.groupBy(KEY, F.col("of.start").alias("context_a"), F.col("of.apex").alias("apex"), F.col("of.finish").alias("context_b")).agg(F.min(F.struct(ORDER, "settled")).alias("w"))
    return first.select(KEY, "context_a", "context_b", F.col(f"w.{ORDER}").alias("a"), F.col("w.settled").alias("b"))


def long_stretches(spans: DataFrame, share: float = 0.5) -> DataFrame:
    """Stretches at least `share` as long as the series' longest."""
    return spans.withColumn("_m", F.max(F.col("b") - F.col("a")).over(Window.partitionBy(KEY))).where(F.col("b") - F.col("a") >= share * F.col("_m")).drop("_m")


def open_stretches(spans: DataFrame, bounds: DataFrame) -> DataFrame:
    """What the spans leave of each series' [first, last]: (series, a, b) with b > a."""
    edges = spans.select(KEY, "a", "b")
    ends = bounds.select(KEY, F.col("first").alias("a"), F.col("first").alias("b")).union(bounds.select(KEY, F.col("last").alias("a"), F.col("last").alias("b")))
    w = Window.partitionBy(KEY).orderBy("a", "b")
    return edges.union(ends).withColumn("_to", F.lead("a").over(w)).select(KEY, F.col("b").alias("a"), F.col("_to").alias("b")).where("b > a")


def climb_start(df: DataFrame, v: str = "v", floor: float = 0.1) -> DataFrame:
    """Per series: the last sample at most 10 % up before the last crossing of the halfway level."""
    w = along()
    whole = Window.partitionBy(KEY)
    lo, hi = F.min(v).over(whole), F.max(v).over(whole)
    s = df.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_p", F.lag(v).over(w))
    mid = (F.col("_lo") + F.col("_hi")) / 2
    s = s.withColumn("_k", F.max(F.when((F.col("_p") < mid) & (F.col(v) >= mid), F.col(ORDER))).over(whole))
    low = F.col(v) <= F.col("_lo") + floor * (F.col("_hi") - F.col("_lo"))
    return s.groupBy(KEY).agg(F.max("_k").alias("crossing"), F.coalesce(F.max(F.when(low & (F.col(ORDER) <= F.col("_k")), F.col(ORDER))), F.min(ORDER)).alias("climb_start"))
