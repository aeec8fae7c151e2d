"""Structured Streaming forms: event-time windows, sessions and online lost spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """TIMESTAMP_NTZ takes no watermark, so the time is cast first."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "3 hours", key: str = "event_type", slide: str | None = None) -> DataFrame:
    """Count and mean per key and window; the same expression for batch and stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.groupBy(F.col(key).alias("series"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return out.select("series", F.col("w.start").alias("w_start"), "n", "v")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    """Stretches of events of a key no further apart than the gap."""
    out = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")


SPANS = "series string, a long, b long, open boolean"
STATE = "a long, b long"


def lost_spans_online(samples: DataFrame, least: int):
    """Stretches of missing samples (series, i, missing) of at least `least` samples, as they close.

    State per series is one open stretch (two numbers), whatever the stream's length."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a, b = state.get if state.exists else (-1, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values("i")
        for i, gone in zip(rows["i"].tolist(), rows["missing"].tolist(), strict=True):
            if gone:
                a, b = (i, i) if a < 0 else (a, i)
            elif a >= 0:
                if b - a + 1 >= least:
                    out.append((key[0], a, b, False))
                a = b = -1
        state.update((a, b))
        yield pd.DataFrame(out, columns=["series", "a", "b", "open"])

    return samples.groupBy("series").applyInPandasWithState(step, SPANS, STATE, "append", "NoTimeout")
