"""Records, seeds and quality of a tracked machine: joins over samples, detections and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import geometry as geo

FRAME = ["clip", "sample"]
PIXEL = [*FRAME, "y", "x"]


def build_records(samples: DataFrame, masks: DataFrame, confidence: DataFrame, bucket: DataFrame, detections: DataFrame, frame_area: float) -> DataFrame:
    """One record per sample; what a source lacks reads as absent, a share or confidence as 0."""
    out = samples.join(masks.withColumnRenamed("area", "_m"), FRAME, "left").join(confidence, FRAME, "left").join(bucket.withColumnRenamed("area", "_b"), FRAME, "left").join(detections, FRAME, "left")
    share = lambda c: F.coalesce(F.col(c) / frame_area, F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*samples.columns, F.col("_m").isNotNull().alias("has_mask"), share("_m").alias("mask_share"), zero("sam_confidence").alias("sam_confidence"), F.col("_b").isNotNull().alias("has_bucket"), share("_b").alias("bucket_share"), zero("bucket_confidence").alias("bucket_confidence"), "detection_score")


def on_spine(boxes: DataFrame, spine: DataFrame) -> DataFrame:
    """A row for every sample; NULL edges where it has no mask."""
    return spine.join(boxes, FRAME, "left")


def half_open(pixels: DataFrame) -> DataFrame:
    """Boxes whose far edges lie one past the last pixel, and how much of each is filled."""
    b = pixels.select(*PIXEL).distinct().groupBy(*FRAME).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("area"))
    return b.withColumn("compactness", F.col("area") / F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1)))


def algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels per frame in both masks, in either, and in `a` alone."""
    both = a.select(*PIXEL, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(*PIXEL, F.lit(0), F.lit(1))).groupBy(*PIXEL).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.groupBy(*FRAME).agg(F.sum(F.col("a") * F.col("b")).alias("n_and"), F.count("*").alias("n_or"), F.sum(F.col("a") * (1 - F.col("b"))).alias("n_without"))


def inside_core(pixels: DataFrame, core: DataFrame) -> DataFrame:
    """The pixels of each frame that lie in the clip's core."""
    return pixels.select(*PIXEL).distinct().join(core.select("clip", "y", "x"), ["clip", "y", "x"], "left_semi")


def bucket_quality(masks: DataFrame, bucket: DataFrame, samples: DataFrame, coverage: float = 0.9, containment: float = 0.8, ratio: float = 4.0) -> DataFrame:
    """Coverage, median containment in the machine and area stability of each clip's bucket."""
    a = bucket.select(*PIXEL).distinct().join(masks.select(*PIXEL).distinct().withColumn("_in", F.lit(1)), PIXEL, "left")
    has = masks.select(*FRAME).distinct().withColumn("_has", F.lit(True))
    per = a.groupBy(*FRAME).agg(F.count("*").alias("area"), F.count("_in").alias("inner")).join(has, FRAME, "left").withColumn("share", F.when(F.col("_has"), F.col("inner") / F.col("area")))
    q = per.groupBy("clip").agg(F.count("*").alias("found"), F.median("share").alias("containment"), F.percentile("area", 0.9).alias("p90"), F.percentile("area", 0.1).alias("p10"), F.median("area").alias("area_median"))
    q = samples.groupBy("clip").agg(F.count("*").alias("samples")).join(q, "clip", "left").withColumn("coverage", F.coalesce(F.col("found") / F.col("samples"), F.lit(0.0))).withColumn("spread", F.try_divide("p90", "p10"))
    note = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), text)
    notes = F.concat_ws(",", note(F.col("coverage") < coverage, "coverage"), note(F.col("containment") < containment, "containment"), note(F.col("spread") > ratio, "spread"))
    return q.select("clip", "samples", F.coalesce("found", F.lit(0)).alias("found"), "coverage", "containment", "spread", "area_median", notes.alias("notes"))


def is_apex(margin: float = 0.08) -> Column:
    """The band lies on top of the machine: it is the boom's apex and not the bucket."""
    return F.col("band_y") - F.col("mask_top") < margin * F.greatest(F.col("scale"), F.lit(1.0))


def seed_scores(band: DataFrame, masks: DataFrame, reach: DataFrame, truck: tuple[float, float, float, float], scale: float) -> DataFrame:
    """How good each frame is to seed from: reach, compactness, clearance and nearness to mid-clip.

    Frames with a band pixel in the truck's box are left out; an apex or a reach of 0 scores 0."""
    x0, y0, x1, y1 = truck
    blob = half_open(band).join(band.select(*PIXEL).distinct().groupBy(*FRAME).agg(F.avg("x").alias("cx"), F.avg("y").alias("band_y"), F.bool_or(F.col("x").between(round(x0), round(x1)) & F.col("y").between(round(y0), round(y1))).alias("touches")), FRAME)
    top = masks.groupBy(*FRAME).agg(F.min("y").alias("mask_top"))
    clip = Window.partitionBy("clip")
    rows = blob.join(top, FRAME, "left").join(reach, FRAME).withColumn("scale", F.lit(float(scale))).withColumn("position", F.row_number().over(clip.orderBy("sample")) - 1).withColumn("total", F.count("*").over(clip))
    gap = F.least(F.abs(F.col("cx") - x0), F.abs(F.col("cx") - x1))
    clearance = F.when(F.col("cx").between(x0, x1), 0.0).otherwise(F.least(gap / max(scale * 0.5, 1.0), F.lit(1.0)))
    mid = 1 - F.abs(F.col("position") - F.col("total") / 2) / F.greatest(F.col("total") / 2, F.lit(1.0))
    score = F.col("reach") / max(scale, 1.0) + F.col("compactness") + clearance + 0.5 * mid
    usable = (F.col("reach") > 0) & ~F.coalesce(is_apex(), F.lit(False))
    return rows.where("not touches").select(*FRAME, F.when(usable, score).otherwise(0.0).alias("score"))


def best_seed(scores: DataFrame) -> DataFrame:
    """The frame of each clip with the highest score; of equals the earliest."""
    return scores.groupBy("clip").agg(F.max_by("sample", F.struct("score", -F.col("sample"))).alias("sample"), F.max("score").alias("score"))


def core_sweep(pixels: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """Size and box of the stable core at several quantiles, from one pass of occupancy."""
    occ = geo.occupancy(pixels)
    cut = occ.groupBy("clip").agg(F.percentile("occ", F.array(*map(F.lit, quantiles))).alias("cuts"))
    cut = cut.select("clip", F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("q"), F.col("cuts").alias("cut"))).alias("z")).select("clip", F.col("z.q").alias("q"), F.col("z.cut").alias("cut"))
    return occ.join(cut, "clip").where("occ >= cut").groupBy("clip", "q").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def rolling_boxes(boxes: DataFrame, half: int) -> DataFrame:
    """The box around all frames from `half` before to `half` after; NULL near the ends."""
    w = Window.partitionBy("clip").orderBy("sample").rowsBetween(-half, half)
    whole = F.count("*").over(w) == 2 * half + 1
    return boxes.select(*FRAME, *(F.when(whole, f(c).over(w)).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))))


def reprocessed(rows: DataFrame, spans: DataFrame, again: DataFrame, most: int = 5) -> DataFrame:
    """Lost spans are filled from a second pass: only inside a span, each once, `most` per series."""
    first = spans.withColumn("_n", F.row_number().over(Window.partitionBy("series").orderBy("a"))).where(F.col("_n") <= most)
    inside = first.select("series", F.explode(F.sequence("a", "b")).alias("i")).withColumn("_in", F.lit(True))
    return rows.join(inside, ["series", "i"], "left").join(again.select("series", "i", F.col("v").alias("_new")), ["series", "i"], "left").select("series", "i", F.when(F.col("_in"), F.coalesce("_new", "v")).otherwise(F.col("v")).alias("v"), F.coalesce("_in", F.lit(False)).alias("redone"))


def stability(boxes: DataFrame, half: int) -> DataFrame:
    """How much each edge moves around a frame: deviation (of the whole window) and range over 2 * half + 1 frames."""
    w = Window.partitionBy("clip").orderBy("sample").rowsBetween(-half, half)
    whole = F.count("*").over(w) == 2 * half + 1
    edges = ("x0", "y0", "x1", "y1")
    deviation = [F.when(whole, F.stddev_pop(c).over(w)).alias(f"{c}_deviation") for c in edges]
    return boxes.select(*FRAME, *deviation, *(F.when(whole, F.max(c).over(w) - F.min(c).over(w)).cast("double").alias(f"{c}_range") for c in edges))
