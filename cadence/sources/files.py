"""File sources and sinks: masks by object, phases, scenes, feature tables, run records."""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHASES_SCHEMA = "clip string, phases array<struct<phase:string,time:double,low_agreement:boolean,fallback:boolean>>"
SCENE_SCHEMA = "clip string, pivot array<double>, scale double, truck_box array<double>"


def write_masks(masks: DataFrame, path: str) -> None:
    """masks: clip, object, sample, rle, height, width. One folder per object; one without rows has none."""
    masks.repartition("object", "clip").sortWithinPartitions("object", "clip", "sample").write.mode("overwrite").partitionBy("object").parquet(path)


def read_masks(spark: SparkSession, path: str, object: str | None = None) -> DataFrame:
    """All objects, or one: then only its folder is read. An object that was not written has no rows."""
    rows = spark.read.schema("clip string, sample long, rle array<bigint>, height int, width int, object string").parquet(path)
    return rows if object is None else rows.where(F.col("object") == object)


def write_phases(starts: DataFrame, path: str) -> None:
    """JSON lines, one per clip, its phases in order of time."""
    one = F.struct("time", "phase", "low_agreement", "fallback")
    rows = starts.groupBy("clip").agg(F.array_sort(F.collect_list(one)).alias("p"))
    named = F.transform("p", lambda x: F.struct(x["phase"].alias("phase"), x["time"].alias("time"), x["low_agreement"].alias("low_agreement"), x["fallback"].alias("fallback")))
    rows.select("clip", named.alias("phases")).write.mode("overwrite").json(path)


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PHASES_SCHEMA).json(path).select("clip", F.explode("phases").alias("p")).select("clip", "p.*")


def write_scenes(scenes: DataFrame, path: str) -> None:
    """scenes: clip, px, py, reach and the truck's edges, NULL where there is no truck."""
    box = F.when(F.col("tx0").isNotNull(), F.array("tx0", "ty0", "tx1", "ty1"))
    scenes.select("clip", F.array("px", "py").alias("pivot"), F.col("reach").alias("scale"), box.alias("truck_box")).write.mode("overwrite").json(path)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    edges = [F.get("truck_box", F.lit(k)).alias(c) for k, c in enumerate(("tx0", "ty0", "tx1", "ty1"))]
    return spark.read.schema(SCENE_SCHEMA).json(path).select("clip", F.get("pivot", F.lit(0)).alias("px"), F.get("pivot", F.lit(1)).alias("py"), F.col("scale").alias("reach"), *edges)


def write_features(features: DataFrame, path: str) -> None:
    """A feature table, ordered by time within each series."""
    features.repartition("series").sortWithinPartitions("series", "i").write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns, or those named; one that the table lacks is an error."""
    rows = spark.read.parquet(path)
    return rows if columns is None else rows.select(*columns)


@contextlib.contextmanager
def run_record(spark: SparkSession, path: str, **given) -> Iterator[dict]:
    """Append one record of a run to `path`, whether it succeeds or fails; the body may add to it."""
    record = {**given, "started": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    began = time.monotonic()
    try:
        yield record
        record["status"] = "ok"
    except BaseException as e:
        record["status"], record["error"] = "failed", f"{type(e).__name__}: {e}"
        raise
    finally:
        record["seconds"] = round(time.monotonic() - began, 3)
        spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("append").text(path)
