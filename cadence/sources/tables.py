"""Reading the tables, and turning events into regular series.

A series table has (series, i, v): one row per slot, NULL where nothing was measured. NaN never
enters: it becomes NULL here, as comparisons with NaN differ from those with a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(column: str | Column) -> Column:
    """NaN counts as not measured."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nanvl(c, F.lit(None).cast("double"))


def regular_grid(events: DataFrame, key: str, seconds: int, value: str = "value", time: str = "ts") -> DataFrame:
    """Mean value per series and slot of `seconds`; slots between the first and last are all there.

    One shuffle by series and slot for the means (combined on the map side), one by series."""
    # in TIMESTAMP_NTZ, so that the session's time zone plays no part
    since = F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({time} AS TIMESTAMP_NTZ))")
    slot = F.floor(since / seconds).cast("long")
    means = events.select(F.col(key).cast("string").alias("series"), slot.alias("slot"), measured(value).alias("x")).groupBy("series", "slot").agg(F.round(F.avg("x"), 6).alias("v"))
    w = Window.partitionBy("series").orderBy("slot")
    # a row fills the empty slots that follow it, so no separate spine is joined
    means = means.withColumn("first", F.min("slot").over(Window.partitionBy("series"))).withColumn("next", F.lead("slot").over(w))
    upto = F.coalesce(F.col("next"), F.col("slot") + 1) - 1
    return means.select("series", "slot", "first", "v", F.explode(F.sequence("slot", upto)).alias("at")).select("series", (F.col("at") - F.col("first")).alias("i"), F.when(F.col("at") == F.col("slot"), F.col("v")).alias("v"))


def strided(samples: DataFrame, rate_hz: float, native_hz: float, start: float | None = None, end: float | None = None, key: str = "series", order: str = "i", time: str = "t") -> DataFrame:
    """Every k-th sample, k = max(1, native / rate rounded half to even), trimmed in time."""
    k = max(1, round(native_hz / rate_hz))
    out = samples.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).where(F.col("_n") % k == 0).drop("_n")
    if start is not None:
        out = out.where(F.col(time) >= start)
    if end is not None:
        out = out.where(F.col(time) <= end)
    return out
