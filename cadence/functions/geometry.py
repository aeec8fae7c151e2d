"""Box and mask geometry as column expressions and pixel-table operators.

Pixel tables: (clip, sample, y, x). Three box conventions exist side by side and are kept apart:
inclusive corners (+1) for own-area overlap and aspect, exclusive ones for IoU, and a share of
width gated on height for standing over the truck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str) -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def _span(lo: Column, hi: Column, plus: int) -> Column:
    return F.greatest(hi - lo + plus, F.lit(0.0))


def overlap_fraction(a: Box, b: Box) -> Column:
    """Share of a's area inside b, corners included."""
    shared = _span(F.greatest(a[0], b[0]), F.least(a[2], b[2]), 1) * _span(F.greatest(a[1], b[1]), F.least(a[3], b[3]), 1)
    return F.coalesce(F.try_divide(shared, _span(a[0], a[2], 1) * _span(a[1], a[3], 1)), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, corners not included; 0 for empty boxes."""
    area = lambda x: _span(x[0], x[2], 0) * _span(x[1], x[3], 0)
    shared = _span(F.greatest(a[0], b[0]), F.least(a[2], b[2]), 0) * _span(F.greatest(a[1], b[1]), F.least(a[3], b[3]), 0)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def over_truck(a: Box, truck: Box) -> Column:
    """Share of a's width above the truck, if its centre is above the truck's middle.

    The width is read to a billionth of a pixel, or what its edges lost as doubles would tip shares that lie on a rounding edge."""
    share = F.try_divide(_span(F.greatest(a[0], truck[0]), F.least(a[2], truck[2]), 0), F.round(a[2] - a[0], 9))
    return F.when((a[1] + a[3]) / 2 < (truck[1] + truck[3]) / 2, F.coalesce(share, F.lit(0.0))).otherwise(F.lit(0.0))


def aspect_ratio(a: Box) -> Column:
    return (a[2] - a[0] + 1) / F.greatest(a[3] - a[1] + 1, F.lit(1e-9))


def bounding_boxes(pixels: DataFrame) -> DataFrame:
    """Inclusive bounding box of each sample's pixels."""
    return pixels.groupBy("clip", "sample").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"))


def occupancy(pixels: DataFrame, framed: DataFrame | None = None) -> DataFrame:
    """Share of a clip's samples that hold each pixel. framed: the same pixels by frame, where others share that shuffle."""
    n = pixels.groupBy("clip").agg(F.count_distinct("sample").alias("n"))
    return (pixels if framed is None else framed).select("clip", "sample", "y", "x").distinct().groupBy("clip", "y", "x").agg(F.count(F.lit(1)).alias("m")).join(n, "clip").select("clip", "y", "x", (F.col("m") / F.col("n")).alias("occ"))


def stable_core(pixels: DataFrame, quantile: float = 0.9, framed: DataFrame | None = None) -> DataFrame:
    """Pixels whose occupancy reaches the clip's quantile of occupancies."""
    occ = occupancy(pixels, framed)
    cut = occ.groupBy("clip").agg(F.percentile("occ", F.lit(quantile)).alias("cut"))
    return occ.join(cut, "clip").where(F.col("occ") >= F.col("cut")).select("clip", "y", "x", "occ")


def core_areas(core: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, area): pixels of each clip's core, 0 for a clip that has none."""
    area = core.groupBy("clip").agg(F.count(F.lit(1)).alias("area"))
    return clips.select("clip").distinct().join(area, "clip", "left").select("clip", F.coalesce("area", F.lit(0)).alias("area"))


def rotation_centre(core: DataFrame) -> DataFrame:
    return core.groupBy("clip").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def boom_base(core: DataFrame, upper: float = 0.2) -> DataFrame:
    """Mean place of the upper fifth of the core (y grows downwards)."""
    cut = core.groupBy("clip").agg(F.percentile("y", F.lit(upper)).alias("cut"))
    # no filter, which Spark would push below the core's shuffles and so make them anew
    upper_part = lambda c: F.avg(F.when(F.col("y") <= F.col("cut"), F.col(c)))
    return core.join(cut, "clip").groupBy("clip").agg(upper_part("x").alias("bx"), upper_part("y").alias("by")).where("by is not null")


def farthest(pixels: DataFrame, centre: DataFrame) -> DataFrame:
    """Per sample the pixel farthest from the clip's centre; of equals the first by row, then column."""
    d = pixels.join(centre, "clip").withColumn("d2", (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    best = F.max(F.struct("d2", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx")))
    return d.groupBy("clip", "sample").agg(best.alias("m")).select("clip", "sample", (-F.col("m.nx")).alias("x"), (-F.col("m.ny")).alias("y"), F.sqrt("m.d2").alias("reach"))


def reaches(pixels: DataFrame) -> DataFrame:
    """(clip, sample, reach) of `farthest`, without its place; pixels have their clip's centre (cx, cy)."""
    return pixels.groupBy("clip", "sample").agg(F.sqrt(F.max((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)).alias("reach"))


def arm_reach(tips: DataFrame, percentile: float = 0.95) -> DataFrame:
    return tips.groupBy("clip").agg(F.percentile("reach", F.lit(percentile)).alias("arm_reach"))


def rle_encode(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """Run lengths per key in order; the first run counts misses and may be 0."""
    w = Window.partitionBy(key).orderBy(order)
    h = rows.select(key, order, F.coalesce(hit, F.lit(False)).alias("_h"))
    h = h.withColumn("_run", F.sum(F.when(F.col("_h") != F.coalesce(F.lag("_h").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    per = h.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_run", "n"))), lambda x: x["n"]).alias("rle"), F.min("_run").alias("_first"))
    return out.select(key, F.when(F.col("_first") > 0, F.concat(F.array(F.lit(0).cast("long")), "rle")).otherwise(F.col("rle")).alias("rle"))


def rle_decode(encoded: DataFrame, key: str) -> DataFrame:
    """(key, pos): the places of the hits."""
    e = encoded.select(key, "rle", F.posexplode("rle").alias("k", "n")).where("k % 2 = 1 and n > 0")
    start = F.aggregate(F.slice("rle", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select(key, F.explode(F.sequence(start, start + F.col("n") - 1)).alias("pos"))


def inner_share(pixels: DataFrame, other: DataFrame) -> DataFrame:
    """Per sample the share of its pixels that the other mask holds too."""
    hit = pixels.join(other.select("clip", "sample", "y", "x", F.lit(1).alias("_in")).distinct(), ["clip", "sample", "y", "x"], "left")
    return hit.groupBy("clip", "sample").agg((F.count("_in") / F.count(F.lit(1))).alias("containment"))
