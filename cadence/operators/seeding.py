"""Where to point a tracker at the bucket: scene, bands along the arm, scored frames, prompt points.

Everything but the walk through a frame's mask and the choice of its points is relational: core,
pivot and scale are aggregates of a clip's pixels, the body is taken off by a join with the
dilated core, frames are scored in one aggregation and chosen by one more. Every frame is walked
once, for its score; only the frames that were chosen get points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import geometry as geo

from . import machine, masks, tracks

FRAME = ["clip", "sample"]
PIXEL = [*FRAME, "y", "x"]


def scene(pixels: DataFrame, detections: DataFrame, quantile: float = 0.9, percentile: float = 0.95, most_iou: float = 0.3) -> DataFrame:
    """(clip, px, py, reach, tx0, ty0, tx1, ty1): rotation centre, arm reach, and the truck's box (NULL if never seen clearly).

    detections: clip, x0, y0, x1, y1 of the truck, iou with the machine."""
    pivot = geo.rotation_centre(geo.stable_core(pixels, quantile))
    reach = geo.arm_reach(geo.farthest(pixels, pivot), percentile)
    truck = tracks.median_box(detections, most_iou=most_iou).select("clip", *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")))
    return pivot.join(reach, "clip").join(truck, "clip", "left").select("clip", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("arm_reach").alias("reach"), "tx0", "ty0", "tx1", "ty1")


def dilated(core: DataFrame, half: int = 2) -> DataFrame:
    """The core's pixels and all within `half` rows and columns of them."""
    around = F.sequence(F.lit(-half), F.lit(half))
    wide = core.select("clip", "y", "x").withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around))
    return wide.select("clip", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()


def arm_bands(pixels: DataFrame, core: DataFrame, base: DataFrame, bucket_from: float = 0.82, stick: tuple[float, float] = (0.5, 0.75), few: bool | None = None) -> DataFrame:
    """Pixels with `band` ('far': the bucket, 'middle': the stick) and the frame's `reach`.

    The walk starts at the base and runs through the whole mask, body included, or it would be
    caught in one of the pieces the arm falls into; the body goes from the bands afterwards."""
    start = base.select("clip", F.bround("by").cast("long").alias("sy"), F.bround("bx").cast("long").alias("sx"))
    found = masks.bands(masks.geodesic_distance(pixels, start, few, min(bucket_from, stick[0])), bucket_from, stick)
    return found.join(dilated(core), ["clip", "y", "x"], "left_anti").select(*PIXEL, "steps", "band", "reach")


def clearance(centre: Column, left: Column, right: Column, scale: Column) -> Column:
    """0 over the truck, up to 1 half the arm's reach away from it; 1 without a truck."""
    gap = F.least(F.abs(centre - left), F.abs(centre - right)) / F.greatest(scale * 0.5, F.lit(1.0))
    return F.when(left.isNull(), 1.0).when(centre.between(left, right), 0.0).otherwise(F.least(gap, F.lit(1.0)))


def frame_scores(bands: DataFrame, pixels: DataFrame, scales: DataFrame, spans: DataFrame, trucks: DataFrame, clear: bool = False, least: int = 25) -> DataFrame:
    """(clip, span, sample, score, reach, x0, y0, x1, y1): every frame of a span with a bucket band of `least` pixels.

    Reach in arm lengths, how much of its box the band fills, clearance from the truck, and how
    near the middle of the span; 0 where the band is the boom's apex. With `clear`, a frame with
    a band pixel in the truck's box is out. spans: clip, span, first, last (samples).
    scales: clip, arm_reach. trucks: clip, tx0, ty0, tx1, ty1."""
    far = bands.where("band = 'far'").select(*PIXEL, "reach").distinct()
    return _scored(far.join(trucks, "clip", "left"), pixels, scales, spans, clear, least)


def _scored(far: DataFrame, pixels: DataFrame, scales: DataFrame, spans: DataFrame, clear: bool, least: int) -> DataFrame:
    """`frame_scores` of the bucket bands' pixels, each there once, with their clip's truck."""
    edges = [F.bround(c) for c in ("tx0", "ty0", "tx1", "ty1")]
    over = F.coalesce(F.col("x").between(edges[0], edges[2]) & F.col("y").between(edges[1], edges[3]), F.lit(False))
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")]
    blob = far.groupBy(*FRAME, "reach", "tx0", "tx1").agg(*box, F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("band_y"), F.bool_or(over).alias("touches")).where(F.col("area") >= least)
    if clear:
        blob = blob.where("not touches")
    top = pixels.groupBy(*FRAME).agg(F.min("y").alias("mask_top"))
    rows = blob.join(top, FRAME).join(scales.select("clip", F.col("arm_reach").alias("scale")), "clip").join(spans, "clip").where("sample between first and last")
    half = (F.col("last") - F.col("first") + 1) / 2
    mid = 1 - F.abs(F.col("sample") - F.col("first") - half) / F.greatest(half, F.lit(1.0))
    filled = F.col("area") / F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1))
    score = F.col("reach") / F.greatest("scale", F.lit(1.0)) + filled + clearance(F.col("cx"), F.col("tx0"), F.col("tx1"), F.col("scale")) + 0.5 * mid
    return rows.select("clip", "span", "sample", F.when(machine.is_apex(), 0.0).otherwise(score).alias("score"), "reach", "x0", "y0", "x1", "y1")


def best_frames(scores: DataFrame) -> DataFrame:
    """The best frame of each span; of equals the earliest."""
    best = Window.partitionBy("clip", "span").orderBy(F.desc("score"), "sample")
    return scores.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def bucket_seeds(pixels: DataFrame, samples: DataFrame, trucks: DataFrame, spans: DataFrame | None = None, clear: bool = False, points: int = 5, negatives: int = 3, quantile: float = 0.9, percentile: float = 0.95, least: int = 25) -> DataFrame:
    """(clip, span, sample, score, reach, x0, y0, x1, y1, points, negatives): the best frame of each clip (or span) to prompt on.

    Core, pivot and scale come from all of a clip's pixels, the candidates from the span alone.
    Points (arrays of x, y) lie inside the bucket's band, negatives inside the stick's. A clip
    or span without a usable frame has no row. samples: clip, sample, all that were looked at."""
    core = geo.stable_core(pixels, quantile, masks.by_frame(pixels))
    base = geo.boom_base(core)
    few = masks.few_clips(pixels)
    scales = geo.arm_reach(geo.reaches(masks.with_clip(pixels, geo.rotation_centre(core), few)), percentile)
    if spans is None:
        spans = samples.groupBy("clip").agg(F.lit(0).cast("long").alias("span"), F.min("sample").alias("first"), F.max("sample").alias("last"))
    far = arm_bands(pixels, core, base, few=few).where("band = 'far'").select(*PIXEL, "reach")
    chosen = best_frames(_scored(far.join(F.broadcast(trucks) if few else trucks, "clip", "left"), pixels, scales, spans, clear, least))
    # the chosen frames alone are walked again, for their points
    inside = arm_bands(pixels.join(chosen.select(*FRAME).distinct(), FRAME, "left_semi"), core, base, few=few)

    def spots(band: str, count: int, name: str) -> DataFrame:
        found = masks.interior_points(inside.where(F.col("band") == band), count, least)
        ordered = F.array_sort(F.collect_list(F.struct("nth", "x", "y")))
        return found.groupBy(*FRAME).agg(F.transform(ordered, lambda p: F.array(p["x"], p["y"])).alias(name))

    out = chosen.join(spots("far", points, "points"), FRAME, "left").join(spots("middle", negatives, "negatives"), FRAME, "left")
    none = F.array().cast("array<array<bigint>>")
    return out.select(*chosen.columns, F.coalesce("points", none).alias("points"), F.coalesce("negatives", none).alias("negatives"))


def prompts(seeds: DataFrame, bands: DataFrame, form: str) -> DataFrame:
    """(clip, sample, prompt): a seed as what a tracker takes: its band ('mask'), its box, or its points with labels 1 and 0."""
    if form == "box":
        return seeds.select(*FRAME, F.struct(F.array("x0", "y0", "x1", "y1").alias("box")).alias("prompt"))
    if form == "points":
        labels = F.concat(F.transform("points", lambda _: F.lit(1)), F.transform("negatives", lambda _: F.lit(0)))
        return seeds.select(*FRAME, F.struct(F.concat("points", "negatives").alias("points"), labels.alias("labels")).alias("prompt"))
    if form == "mask":
        far = bands.where("band = 'far'").groupBy(*FRAME).agg(F.array_sort(F.collect_set(F.array("y", "x"))).alias("pixels"))
        return seeds.select(*FRAME).join(far, FRAME).select(*FRAME, F.struct("pixels").alias("prompt"))
    raise ValueError(f"a prompt is a mask, a box or points, not {form!r}")
