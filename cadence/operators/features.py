"""From smoothed boxes and a scene to the feature and signal columns; all window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.geometry import aspect_ratio, box, over_truck, overlap_fraction

from .search import axis, projected
from .series import derivative, moving_average

EDGES = ("x0", "y0", "x1", "y1")


def smoothed(boxes: DataFrame, prefixes: tuple[str, ...], width: int, align: str = "trailing") -> DataFrame:
    """Every edge averaged; `<prefix>found` tells whether the box was there before smoothing."""
    out = boxes
    for p in prefixes:
        out = out.withColumn(f"{p}found", F.col(f"{p}x0").isNotNull())
    return out.select(*[c for c in out.columns if not any(c == p + e for p in prefixes for e in EDGES)], *(moving_average(p + e, width, align).alias(p + e) for p in prefixes for e in EDGES))


def assemble(boxes: DataFrame, scene: DataFrame, half: int, dt: float) -> DataFrame:
    """(series, i, t, b*, c* edges) and one scene row per series -> features, in units of the reach.

    scene: series, px, py, reach and the truck's tx0..ty1 (NULL without a truck). y grows
    downwards and is turned over in `height`, `rel_cabin_y` and `rel_truck_y`: positive is above."""
    # one row per series; joined on its key
    j = boxes.join(scene, "series")
    mid = lambda p, a, b: (F.col(p + a) + F.col(p + b)) / 2 / F.col("reach")
    j = j.withColumn("bucket_x", mid("b", "x0", "x1")).withColumn("bucket_y", mid("b", "y0", "y1")).withColumn("cabin_x", mid("c", "x0", "x1")).withColumn("cabin_y", mid("c", "y0", "y1"))
    j = j.withColumn("height", F.col("py") / F.col("reach") - F.col("bucket_y"))
    for source, name in (("height", "dh_dt"), ("bucket_x", "dx_dt"), ("dh_dt", "d2h_dt2"), ("bucket_y", "dy_dt")):
        j = derivative(j, source, name, half, dt)
    truck, mine = box("t"), box("b")
    known = F.col("tx0").isNotNull()
    j = j.withColumn("speed_x", F.abs("dx_dt")).withColumn("speed_2d", F.hypot("dx_dt", "dy_dt"))
    j = j.withColumn("rel_cabin_x", F.col("bucket_x") - F.col("cabin_x")).withColumn("rel_cabin_y", F.col("cabin_y") - F.col("bucket_y"))
    j = j.withColumn("rel_truck_x", F.col("bucket_x") - mid("t", "x0", "x1")).withColumn("rel_truck_y", mid("t", "y0", "y1") - F.col("bucket_y"))
    j = j.withColumn("truck_overlap", F.when(known & F.col("bx0").isNotNull(), overlap_fraction(mine, truck)))
    j = j.withColumn("over", F.when(known, F.coalesce(over_truck(mine, truck), F.lit(0.0))).otherwise(F.coalesce("truck_overlap", F.lit(0.0))))
    j = j.withColumn("aspect_ratio", aspect_ratio(mine)).withColumn("radius", F.hypot(F.col("bucket_x") - F.col("px") / F.col("reach"), F.col("bucket_y") - F.col("py") / F.col("reach")))
    return derivative(j, "aspect_ratio", "aspect_ratio_dt", half, dt)


def signals(features: DataFrame, half: int, dt: float) -> DataFrame:
    """Adds the place of bucket and cabin on the line from pile to truck, and its rate.

    Series without a pile or a truck have no line: they are left out here and named by
    `without_line`."""
    rel = features.where("rel_truck_x is not null").withColumn("x", F.col("rel_truck_x")).withColumn("y", F.col("rel_truck_y"))
    line = axis(rel)
    out = projected(rel, line).withColumnRenamed("pos", "pile_truck_pos").drop("x", "y")
    cabin = out.withColumn("x", F.col("rel_truck_x") - F.col("rel_cabin_x")).withColumn("y", F.col("rel_truck_y") - F.col("rel_cabin_y"))
    return derivative(projected(cabin, line).withColumnRenamed("pos", "cabin_pile_truck_pos").drop("x", "y"), "pile_truck_pos", "pile_truck_pos_dt", half, dt)


def without_line(features: DataFrame) -> DataFrame:
    """(series, reason) of series that cannot be searched."""
    per = features.groupBy("series").agg(F.count("rel_truck_x").alias("n"), F.count_if((F.coalesce("over", F.lit(0.0)) <= 0) & F.col("height").isNotNull()).alias("off"))
    return per.select("series", F.when(F.col("n") == 0, "no truck").when(F.col("off") == 0, "no pile").alias("reason")).where("reason is not null")


def checker_features(features: DataFrame, half: int, dt: float) -> DataFrame:
    """The features that cues are checked on: those of `assemble`, with overlap read as standing over the truck.

    Adds truck_box_overlap (the overlap of the boxes in the picture), dy_dt, d2x_dt2, the bucket
    box's size, and the distance to the truck with its rate. Series without a truck are left
    out; `without_line` names them."""
    out = features.withColumn("truck_box_overlap", F.coalesce("truck_overlap", F.lit(0.0))).withColumn("truck_overlap", F.col("over"))
    whole = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    out = out.withColumn("box_w", whole[0]).withColumn("box_h", whole[1]).withColumn("box_area", whole[0] * whole[1])
    out = derivative(out, "dx_dt", "d2x_dt2", half, dt)
    out = out.withColumn("truck_distance", F.hypot("rel_truck_x", "rel_truck_y"))
    known = F.max(F.col("rel_truck_x").isNotNull()).over(Window.partitionBy("series"))
    return derivative(out.withColumn("_known", known).where("_known").drop("_known"), "truck_distance", "truck_distance_dt", half, dt)
