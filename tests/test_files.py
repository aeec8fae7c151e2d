"""Round trips of the file sources and sinks, and linear windows on a long series."""

import json
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from cadence.operators import series
from cadence.sources import files


def test_masks_by_object(spark, tmp_path):
    rows = [("c", "bucket", k, [k, 3, 2], 4, 5) for k in range(5)] + [("c", "excavator", 0, [0, 20], 4, 5)]
    df = spark.createDataFrame(rows, "clip string, object string, sample long, rle array<bigint>, height int, width int")
    files.write_masks(df, str(tmp_path / "m"))
    assert files.read_masks(spark, str(tmp_path / "m")).select(*df.columns).exceptAll(df).count() == 0
    assert files.read_masks(spark, str(tmp_path / "m"), "bucket").count() == 5 and files.read_masks(spark, str(tmp_path / "m"), "truck").count() == 0


def test_phases_scenes_features(spark, tmp_path):
    starts = spark.createDataFrame([("c", "hauling", 2.5, False, True), ("c", "digging", 1.0, True, False)], "clip string, phase string, time double, low_agreement boolean, fallback boolean")
    files.write_phases(starts, str(tmp_path / "p"))
    assert [tuple(r) for r in files.read_phases(spark, str(tmp_path / "p")).collect()] == [("c", "digging", 1.0, True, False), ("c", "hauling", 2.5, False, True)]
    scenes = spark.createDataFrame([("c", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0), ("d", 1.0, 2.0, 3.0, None, None, None, None)], "clip string, px double, py double, reach double, tx0 double, ty0 double, tx1 double, ty1 double")
    files.write_scenes(scenes, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_scenes(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, scenes.collect()))
    table = spark.createDataFrame([("s", k, k / 2) for k in range(9)], "series string, i long, v double")
    files.write_features(table, str(tmp_path / "f"))
    assert files.read_features(spark, str(tmp_path / "f"), ["series", "v"]).count() == 9
    with pytest.raises(Exception, match="nope"):
        files.read_features(spark, str(tmp_path / "f"), ["nope"]).count()


def test_run_record_on_success_and_failure(spark, tmp_path):
    path = str(tmp_path / "runs")
    with files.run_record(spark, path, clip="a") as r:
        r["rows"] = 3
    with pytest.raises(ValueError), files.run_record(spark, path, clip="b"):
        raise ValueError("broken")
    got = {x["clip"]: x for x in (json.loads(r.value) for r in spark.read.text(path).collect())}
    assert got["a"]["status"] == "ok" and got["a"]["rows"] == 3 and got["b"]["status"] == "failed" and "broken" in got["b"]["error"]


def test_long_series_take_linear_time(spark):
    rng = random.Random(3)
    values = [None if rng.random() < 0.2 else rng.random() for _ in range(40_000)]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)], "series string, i long, v double").cache()
    began = time.monotonic()
    medians = {r.i: r.past for r in series.expanding_median(df).collect()}
    filled = df.select("i", series.interpolated("v").alias("x")).where(F.col("x").isNull()).count()
    assert time.monotonic() - began < 15  # quadratic windows took over half a minute each
    for k in (0, 1, 500, 3999):
        past = [v for v in values[:k] if v is not None]
        assert medians[k] == (pytest.approx(statistics.median(past)) if past else None)
    assert filled <= 2
