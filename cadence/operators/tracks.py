"""Per-sample records of a tracked object: gaps, quality, best detections, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.geometry import box, iou


def missing(has_mask: str = "has_mask", confidence: str = "confidence", floor: float = 0.35) -> Column:
    """No mask, or a known confidence below the floor; an unknown confidence counts as present."""
    conf = F.nanvl(F.col(confidence), F.lit(None).cast("double"))
    return ~F.coalesce(F.col(has_mask), F.lit(False)) | F.coalesce(conf < floor, F.lit(False))


def confident(value: Column, present: Column, confidence: Column, floor: float = 0.35) -> Column:
    """The value where its sample can be trusted: NULL where it is there with a known confidence below the floor."""
    doubted = present & F.coalesce(F.nanvl(confidence, F.lit(None).cast("double")) < floor, F.lit(False))
    return F.when(~F.coalesce(doubted, F.lit(False)), value)


def pairs(left: DataFrame, right: DataFrame, keys: list[str], most_iou: float = 0.3) -> DataFrame:
    """Two objects' detections of one sample side by side: keys, iou, clean (hardly overlapping) and merged (at least that much).

    Of equality both hold: a seed asks for less, a merged frame for as much or more."""
    edges = ("x0", "y0", "x1", "y1")
    a = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in edges))
    both = a.join(right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in edges)), keys)
    value = iou(box("l_"), box("r_"))
    return both.select(*keys, value.alias("iou"), (value <= most_iou).alias("clean"), (value >= most_iou).alias("merged"))


def median_box(detections: DataFrame, key: str = "clip", most_iou: float = 0.3) -> DataFrame:
    """Edge-wise median of the boxes that hardly overlap the other object."""
    clean = detections.where(F.coalesce("iou", F.lit(0.0)) <= most_iou)
    return clean.groupBy(key).agg(*(F.median(c).alias(c) for c in ("x0", "y0", "x1", "y1")))


def best_detection(detections: DataFrame, keys: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The detection with the highest score; of equals the smallest id. No sort of whole groups."""
    rest = [c for c in detections.columns if c not in (*keys, score, tie)]
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("n"), *rest))
    return detections.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.n")).alias(tie), F.col("_b.s").alias(score), *(F.col(f"_b.{c}").alias(c) for c in rest))


def seed(candidates: DataFrame, key: str = "clip", most_iou: float = 0.3) -> DataFrame:
    """The best clean candidate of each clip, or the best of all if none is clean."""
    clean = (F.coalesce("iou", F.lit(0.0)) < most_iou).cast("int")
    return best_seed(candidates.withColumn("clean", clean), key)


def best_seed(rows: DataFrame, key: str) -> DataFrame:
    best = F.max(F.struct("clean", "score", (-F.col("sample")).alias("n")))
    return rows.groupBy(key).agg(best.alias("_b")).select(key, (-F.col("_b.n")).alias("sample"), F.col("_b.score").alias("score"), (F.col("_b.clean") == 1).alias("clean"))


def quality(records: DataFrame, key: str = "clip", coverage: float = 0.97, agreement: float = 0.7, most: float = 1.8, least: float = 0.4, bad: float = 0.1) -> DataFrame:
    """Per clip: coverage, median area, shares of odd areas, median agreement, verdict and reasons."""
    found = F.col("area") > 0
    mid = records.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), F.count_if(found).alias("found"), F.median(F.when(found, F.col("area"))).alias("median_area"), F.median("agreement").alias("median_agreement"))
    odd = records.join(mid.select(key, "median_area"), key).groupBy(key).agg(
        F.count_if(found & (F.col("area") > most * F.col("median_area"))).alias("large"), F.count_if(found & (F.col("area") < least * F.col("median_area"))).alias("small")
    )
    q = mid.join(odd, key).withColumn("coverage", F.col("found") / F.col("samples"))
    share = F.try_divide(F.col("large") + F.col("small"), F.col("found"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("coverage") < coverage, "coverage"),
            F.when(F.coalesce(share, F.lit(1.0)) > bad, "area"),
            F.when(F.coalesce("median_agreement", F.lit(1.0)) < agreement, "agreement"),
        )
    )
    return q.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("passed", F.col("reasons") == "")


def reseeds(spans: DataFrame, most: int = 5, key: str = "series") -> DataFrame:
    """The first `most` lost spans of each series, in order: those that get another try."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("a"))
    return spans.withColumn("attempt", n).where(F.col("attempt") <= most)
