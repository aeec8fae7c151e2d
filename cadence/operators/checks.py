"""Checking cues against labelled onsets: first matches, vetoes by rules, and the shape search.

Series are dense (series, i, ...); labels are (series, phase, truth). "The first stretch from an
anchor on" is read off two running values carried backwards along a series, so a scan is one
sort of the series and one equi-join with the labels, not a range join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import Ranked
from .series import KEY, ORDER

#: fixed values: the rules that veto each phase, and those that are only reported
HARD = {"digging": ("D1", "D2"), "hauling": ("H1",), "dumping": ("P1", "P2"), "swinging": ()}
SOFT = {"digging": ("D3", "D4", "D5"), "hauling": ("H3",), "dumping": ("P3", "P4", "P5", "P6"), "swinging": ()}


def next_stretch(hit: Column) -> tuple[Column, Column]:
    """(first, last) of the first run of hits at or after each sample."""
    back = Window.partitionBy(KEY).orderBy(F.col(ORDER).desc())
    ahead = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.coalesce(hit, F.lit(False))
    end = F.coalesce(F.last(F.when(~hit, F.col(ORDER)), True).over(ahead) - 1, F.max(ORDER).over(Window.partitionBy(KEY)))
    return F.last(F.when(hit, F.col(ORDER)), True).over(ahead), end


def anchored(labels: DataFrame, phase: str, back: int = 1) -> DataFrame:
    """Labels of `phase` with the onset `back` places earlier as `anchor`, and the latest dig before."""
    w = Window.partitionBy(KEY).orderBy("truth")
    dig = F.last(F.when(F.col("phase") == "digging", F.col("truth")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return labels.withColumn("anchor", F.lag("truth", back).over(w)).withColumn("dig", dig).where((F.col("phase") == phase) & F.col("anchor").isNotNull())


def matched(found: DataFrame, tolerance: float) -> DataFrame:
    """Adds contains, start_error and centre_error to rows with truth and the stretch (a, b)."""
    inside = (F.col("truth") >= F.col("a") - tolerance) & (F.col("truth") <= F.col("b") + tolerance)
    return found.withColumn("contains", F.coalesce(inside, F.lit(False))).withColumn("start_error", F.col("a") - F.col("truth")).withColumn("centre_error", (F.col("a") + F.col("b")) / 2 - F.col("truth"))


def first_matches(rows: DataFrame, hit: Column, labels: DataFrame, phase: str, tolerance: float, back: int = 1) -> DataFrame:
    """For each onset of `phase`, the first stretch of hits from its anchor on."""
    first, end = next_stretch(hit)
    at = rows.withColumn("_end", end).withColumn("_first", first)
    # a run's end is read where the run begins
    ahead = Window.partitionBy(KEY).orderBy(F.col(ORDER).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumn("_b", F.last(F.when(F.coalesce(hit, F.lit(False)), F.col("_end")), True).over(ahead))
    places = at.select(KEY, F.col(ORDER).alias("anchor"), F.col("_first").alias("a"), F.col("_b").alias("b"))
    return matched(anchored(labels, phase, back).join(places, [KEY, "anchor"], "left"), tolerance).select(KEY, "truth", "anchor", "a", "b", "contains", "start_error", "centre_error")


def rules(side: str = "side") -> dict[str, Column]:
    """The thirteen rules over height, bucket_x, rel_cabin_x/y, rel_truck_x/y, truck_overlap, dig_h, dig_x."""
    c = F.col
    return {
        "D1": c("truck_overlap") <= 0, "D2": c("rel_truck_x") * c(side) < 0, "D3": c("rel_cabin_x") * c(side) < 0, "D4": c("rel_cabin_y") < 0, "D5": c("height") < 0,
        "H1": c("height") > c("dig_h"), "H3": (c("bucket_x") - c("dig_x")) * c(side) > 0,
        "P1": c("rel_cabin_x") * c(side) > 0, "P2": c("height") > c("dig_h"), "P3": c("rel_cabin_y") > 0, "P4": c("height") > 0, "P5": c("rel_truck_y") > 0, "P6": c("truck_overlap") > 0,
    }


def first_matches_ruled(rows: DataFrame, hit: Column, labels: DataFrame, phase: str, tolerance: float, back: int = 1) -> DataFrame:
    """`first_matches` where the hard rules of `phase` must hold too; soft ones at the match are reported.

    dig_h and dig_x are medians of the samples from the onset's latest dig on, before each sample.
    Each series is one group: its heights are ranked once, a median since any dig is then a look-up
    of log n steps, and a scan reads on in stretches of doubling length until it has its match."""
    rule, hard, soft = rules(), HARD[phase], SOFT[phase]
    past = {"H1": ("height", "dig_h"), "P2": ("height", "dig_h"), "H3": ("bucket_x", "dig_x")}
    fixed = [r for r in (*hard, *soft) if r not in past]
    told = sorted({past[r][0] for r in (*hard, *soft) if r in past})
    samples = rows.select(KEY, ORDER, F.coalesce(hit, F.lit(False)).alias("hit"), F.col("side").cast("double").alias("side"), *(F.coalesce(rule[r], F.lit(False)).alias(r) for r in fixed), *(F.col(c).cast("double").alias(c) for c in told))
    # renamed onto itself, as labels may come from the same rows
    onsets = anchored(labels, phase, back).select(KEY, "truth", "anchor", "dig").toDF(KEY, "truth", "anchor", "dig")

    def scan(series: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(ORDER)
        at = series[ORDER].to_numpy()
        ranked = {c: Ranked(series[c].to_numpy(np.float64)) for c in told}
        value = {c: series[c].to_numpy(np.float64) for c in told}
        side = series["side"].to_numpy(np.float64)
        allowed = series["hit"].to_numpy(bool)
        for r in hard:
            if r in fixed:
                allowed = allowed & series[r].to_numpy(bool)

        def holds(r: str, places: np.ndarray, dig: int | None) -> np.ndarray:
            if r in fixed:
                return series[r].to_numpy(bool)[places]
            if dig is None:
                return np.zeros(len(places), bool)
            c = past[r][0]
            begin = np.full(len(places), np.searchsorted(at, dig))
            with np.errstate(invalid="ignore"):
                over = value[c][places] - ranked[c].median(np.minimum(begin, places), places)
                return (places >= begin) & ((over if c == "height" else over * side[places]) > 0)

        def passing(places: np.ndarray, dig: int | None) -> np.ndarray:
            ok = allowed[places].copy()
            for r in hard:
                some = np.flatnonzero(ok)
                if r not in fixed and len(some):
                    ok[some] = holds(r, places[some], dig)
            return ok

        def first_place(begin: int, wanted: bool, dig: int | None) -> int:
            """The first place from `begin` on that passes (or does not); the number of samples if none does."""
            size = 64
            while begin < len(at):
                places = np.arange(begin, min(begin + size, len(at)))
                found = np.flatnonzero(passing(places, dig) == wanted)
                if len(found):
                    return int(places[found[0]])
                begin, size = begin + size, size * 2
            return len(at)

        out = []
        for truth, anchor, dig in zip(asked["truth"].tolist(), asked["anchor"].tolist(), asked["dig"].tolist(), strict=True):
            dig = None if dig is None or dig != dig else dig
            a = first_place(int(np.searchsorted(at, anchor)), True, dig)
            if a == len(at):
                out.append((asked[KEY].iloc[0], truth, anchor, None, None, *(None for _ in soft)))
                continue
            end = first_place(a + 1, False, dig)
            out.append((asked[KEY].iloc[0], truth, anchor, at[a], at[end] - 1 if end < len(at) else at[-1], *(bool(holds(r, np.array([a]), dig)[0]) for r in soft)))
        columns = [KEY, "truth", "anchor", "a", "b", *soft]
        return pd.DataFrame(out, columns=columns).astype({"a": "Int64", "b": "Int64", **dict.fromkeys(soft, "boolean")})

    kinds = {**dict(rows.dtypes), **dict(onsets.dtypes)}
    schema = f"{KEY} {kinds[KEY]}, truth {kinds['truth']}, anchor {kinds['anchor']}, a {kinds[ORDER]}, b {kinds[ORDER]}" + "".join(f", {r} boolean" for r in soft)
    # a label without samples has no scan
    got = samples.groupBy(KEY).cogroup(onsets.groupBy(KEY)).applyInPandas(lambda x, y: scan(x, y) if len(x) and len(y) else pd.DataFrame(columns=[KEY, "truth", "anchor", "a", "b", *soft]), schema)
    return matched(got, tolerance)


def shape_search(read: DataFrame, names: list[str], labels: DataFrame, phase: str, tolerance: float, back: int = 1) -> DataFrame:
    """Every feature with every shape, scored on all onsets of `phase` and ranked.

    read: series (one per clip and feature), clip, feature, i, shape. A shape's next stretch is a
    column of its own; only the samples that are an onset's anchor are laid out by shape."""
    ahead = Window.partitionBy("clip", "feature").orderBy(F.col(ORDER).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(ORDER).over(Window.partitionBy("clip", "feature"))
    out = read
    for k, name in enumerate(names):
        hit = F.coalesce(F.col("shape") == name, F.lit(False))
        end = F.coalesce(F.last(F.when(~hit, F.col(ORDER)), True).over(ahead) - 1, last)
        out = out.withColumn(f"_e{k}", end)
    for k, name in enumerate(names):
        hit = F.coalesce(F.col("shape") == name, F.lit(False))
        out = out.withColumn(f"_s{k}", F.last(F.when(hit, F.struct(F.col(ORDER).alias("a"), F.col(f"_e{k}").alias("b"))), True).over(ahead))
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"_s{k}").alias("s")) for k, n in enumerate(names))))
    onsets = anchored(labels, phase, back).select(F.col(KEY).alias("clip"), "truth", "anchor")
    asked = out.withColumnRenamed(ORDER, "anchor").join(onsets, ["clip", "anchor"])
    places = asked.select("clip", "feature", "truth", "anchor", both.alias("x")).select("clip", "feature", "truth", "anchor", F.col("x.name").alias("shape"), F.col("x.s.a").alias("a"), F.col("x.s.b").alias("b"))
    m = matched(places, tolerance)
    near = lambda c: F.count_if(F.coalesce(F.abs(c) <= tolerance, F.lit(False)))
    worst = lambda c: F.when(F.count(c) == F.count("*"), F.max(F.abs(c)))  # noqa: E731  NULL where an onset has no match
    return m.groupBy("feature", "shape").agg(F.count_if("contains").alias("contains"), F.count("*").alias("n"), near("start_error").alias("start_within"), near("centre_error").alias("centre_within"), worst("start_error").alias("worst_start"), worst("centre_error").alias("worst_centre"))


def context_search(read: DataFrame, labels: DataFrame, phase: str, tolerance: float, contexts: tuple[str, ...], shapes: tuple[str, ...], back: int = 1) -> DataFrame:
    """Every feature with every context (length, word) and every timing (side, shape), scored on each clip's onsets of `phase`.

    A cue is: over the last `length` the feature was <word>, and its short shape of `side` is
    <shape> now. (clip, feature, length, word, side, shape, contains, timed, n, worst); worst is
    NULL where an onset has no match. read: clip, feature, i, words (map of length to word), forms
    (map of side to shape). Samples become runs first; an onset takes the first run that ends at
    or behind its anchor, a running value from the far end: no pairs of samples and onsets."""
    cue = ["clip", "feature", "length", "word", "side", "shape"]
    hits = read.select("clip", "feature", ORDER, F.explode("words").alias("length", "word"), "forms").select("clip", "feature", ORDER, "length", "word", F.explode("forms").alias("side", "shape")).where("word is not null and shape is not null")
    run = F.col(ORDER) - F.row_number().over(Window.partitionBy(*cue).orderBy(ORDER))
    runs = hits.withColumn("_r", run).groupBy(*cue, "_r").agg(F.min(ORDER).alias("a"), F.max(ORDER).alias("b")).drop("_r")
    onsets = anchored(labels, phase, back).select(F.col(KEY).alias("clip"), "truth", "anchor")
    sizes = read.select("clip", "feature", F.map_keys("words").alias("l"), F.map_keys("forms").alias("s")).distinct()
    each = lambda names: F.explode(F.array(*map(F.lit, names)))
    asked = onsets.join(sizes, "clip").withColumn("length", F.explode("l")).withColumn("side", F.explode("s")).withColumn("word", each(contexts)).withColumn("shape", each(shapes))
    none = F.lit(None).cast("long")
    both = runs.select(*cue, F.col("b").alias("at"), F.lit(0).alias("kind"), F.struct("a", "b").alias("run"), none.alias("truth")).union(
        asked.select(*cue, "anchor", F.lit(1), F.lit(None).cast(f"struct<a:{dict(runs.dtypes)['a']},b:{dict(runs.dtypes)['b']}>"), "truth")
    )
    behind = Window.partitionBy(*cue).orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("run", F.last("run", True).over(behind)).where("kind = 1").select(*cue, "truth", F.greatest("at", "run.a").alias("a"), F.col("run.b").alias("b"))
    found = matched(found.withColumn("a", F.when(F.col("b").isNotNull(), F.col("a"))), tolerance)
    worst = F.when(F.count("start_error") == F.count("*"), F.max(F.abs("start_error")))
    return found.groupBy(*cue).agg(F.count_if("contains").alias("contains"), F.count_if(F.coalesce(F.abs("start_error") <= tolerance, F.lit(False))).alias("timed"), F.count("*").alias("n"), worst.alias("worst"))
