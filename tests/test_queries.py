"""Every query against its DuckDB twin on the smallest tables; the streaming forms against batch."""

import datetime
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cadence.operators import patterns
from cadence.plans import cues, following, more, pieces, registry  # noqa: F401
from cadence.sources.tables import load
from cadence.streaming import online

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.4f}".replace("-0.0000", "0.0000")
    return x.replace(tzinfo=None).isoformat() if isinstance(x, datetime.datetime) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", ["open_readings", "reseeded_samples", "checker_sizes"])
def test_places_on_a_rounding_edge(spark, name):
    """All six places, where some values lie halfway between two of them."""
    folder = SF.replace("0.001", "0.01")
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = registry.QUERIES[name](spark, folder)
    want = c.execute(registry.ORACLES[name])
    order = [[d[0] for d in want.description].index(x) for x in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0


def test_stream_equals_batch(spark):
    events = load(spark, SF, "events").select("ts", "event_type", "value")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    q = online.tumbling(online.timed(stream)).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    batch = online.tumbling(online.timed(events))
    assert spark.table("tumbled").select("series", "w_start", "n").exceptAll(batch.select("series", "w_start", "n")).count() == 0
    assert spark.table("tumbled").count() == batch.count()


def test_online_lost_spans_equal_batch(spark, tmp_path):
    rows = [("s", i, i in {3, 4, 5, 9, 12, 13}) for i in range(16)] + [("r", i, i < 2) for i in range(5)]
    df = spark.createDataFrame(rows, "series string, i long, missing boolean")
    for k, (lo, hi) in enumerate(((0, 5), (5, 16))):
        df.where(F.col("i").between(lo, hi - 1)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = online.lost_spans_online(stream, 2).writeStream.outputMode("append").format("memory").queryName("lost").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.series, r.a, r.b) for r in patterns.lost_spans(df, F.col("missing"), 2).collect()}
    assert {(r.series, r.a, r.b) for r in spark.table("lost").collect()} == want
