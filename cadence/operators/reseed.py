"""Finding an object again after it was lost: every lost span once, overwritten only inside.

A lost span is a maximal stretch of missing samples, so the samples on either side of it are
there, and following the object again inside the span changes nothing outside. Whatever stays
missing inside overlaps a span already tried. So trying the first span, looking again, and trying
the next one gives the same as trying the first `most` spans side by side: no loop over the data,
and all spans of all series run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import patterns, tracks

#: rows of lost spans (series, span, a, b, and the samples' columns) -> (series, span, seed) for spans with a usable sample
FindSeed = Callable[[DataFrame], DataFrame]
#: (samples with series and i of spans, seeds: series, seed, first, last) -> (series, i, output, confidence)
TrackSpan = Callable[[DataFrame, DataFrame], DataFrame]


def clear_seed(score: Column, usable: Column) -> FindSeed:
    """The usable sample of the highest score; of equals the earliest. A span without one has none."""

    def find(rows: DataFrame) -> DataFrame:
        best = F.max(F.struct(score.alias("score"), (-F.col("i")).alias("n")))
        return rows.where(usable & score.isNotNull()).groupBy("series", "span").agg(best.alias("best")).select("series", "span", (-F.col("best.n")).alias("seed"))

    return find


def spacing(samples: DataFrame) -> DataFrame:
    """(series, step): the median distance in time of a series' samples, 0 with a single one."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("series").orderBy("i"))
    return samples.select("series", gap.alias("gap")).groupBy("series").agg(F.coalesce(F.median("gap"), F.lit(0.0)).alias("step"))


def lost(samples: DataFrame, floor: float = 0.35, seconds: float = 1.0) -> DataFrame:
    """(series, span, a, b, start, end): stretches without an object that last `seconds`, one spacing included; numbered from 1.

    samples: series, i, t, has_mask, confidence."""
    gone = samples.withColumn("gone", tracks.missing(floor=floor))
    spans = patterns.runs(gone, F.col("gone"))
    at = lambda name, end: spans.select("series", "a", "b").join(samples.select("series", F.col("i").alias(end), F.col("t").alias(name)), ["series", end])
    timed = at("start", "a").join(at("end", "b"), ["series", "a", "b"]).join(spacing(samples), "series")
    long_ = timed.where(F.round(F.col("end") - F.col("start") + F.col("step"), 9) >= seconds)
    return long_.withColumn("span", F.row_number().over(Window.partitionBy("series").orderBy("a"))).select("series", "span", "a", "b", "start", "end")


def reseeded(samples: DataFrame, find_seed: FindSeed, track_span: TrackSpan, floor: float = 0.35, seconds: float = 1.0, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(samples with `output`, has_mask and confidence renewed inside the spans tried, records).

    A record per span tried: start_seconds, end_seconds, missing_before, seed_sample,
    seed_seconds, missing_after; the last three are NULL where no sample qualified. What the
    tracker tells of samples outside the span is passed over; a sample it found nothing in has no
    mask; a confidence that it does not tell stays. samples: series, i, t, has_mask, confidence."""
    spans = lost(samples, floor, seconds).where(F.col("span") <= most)
    # spans of a series never overlap: a sample's span is the last that began before it
    begin = F.last("opened", True).over(Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    opened = F.struct("span", "a", "b").alias("opened")
    marked = samples.join(spans.select("series", F.col("a").alias("i"), opened), ["series", "i"], "left").withColumn("opened", begin)
    marked = marked.withColumn("opened", F.when(F.col("i") <= F.col("opened.b"), F.col("opened")))
    inside = marked.where("opened is not null").select("*", "opened.span", "opened.a", "opened.b").drop("opened")
    seeds = find_seed(inside).select("series", "span", "seed").join(spans.select("series", "span", F.col("a").alias("first"), F.col("b").alias("last")), ["series", "span"])
    found = track_span(inside.select(*samples.columns), seeds.select("series", "seed", "first", "last"))
    found = found.select("series", "i", "output", F.col("confidence").alias("_told"), F.lit(True).alias("_tracked"))
    chosen = seeds.select(F.col("series").alias("_series"), F.col("span").alias("_span"), "seed")
    tried = marked.join(chosen, (F.col("series") == F.col("_series")) & (F.col("opened.span") == F.col("_span")), "left").drop("_series", "_span")
    both = tried.join(found, ["series", "i"], "left")
    again = F.col("seed").isNotNull()
    out = both.withColumn("_has", F.when(again, F.coalesce(F.size("output") > 0, F.lit(False))).otherwise(F.col("has_mask")))
    out = out.withColumn("_conf", F.when(again & F.col("_told").isNotNull(), F.col("_told")).otherwise(F.col("confidence")))
    renewed = out.select(*(F.col({"has_mask": "_has", "confidence": "_conf"}.get(c, c)).alias(c) for c in samples.columns), F.when(again, F.col("output")).alias("output"))
    gone = tracks.missing(floor=floor)
    before = inside.groupBy("series", "span").agg(F.count_if(gone).alias("missing_before"))
    after = out.where(again).select("series", F.col("opened.span").alias("span"), F.col("_has").alias("has_mask"), F.col("_conf").alias("confidence")).groupBy("series", "span").agg(F.count_if(gone).alias("missing_after"))
    seeded = seeds.select("series", "span", F.col("seed").alias("i")).join(samples.select("series", "i", F.col("t").alias("seed_seconds")), ["series", "i"]).withColumnRenamed("i", "seed_sample")
    records = spans.join(before, ["series", "span"]).join(seeded, ["series", "span"], "left").join(after, ["series", "span"], "left")
    return renewed, records.select("series", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), "missing_before", "seed_sample", "seed_seconds", "missing_after")
