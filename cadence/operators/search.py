"""The ordered phase search: gates, movement starts and the fold over one series.

Everything that feeds the search is relational. The search itself is a fold whose next step
depends on where the last window ended, so a series is one group of a grouped Pandas function;
a group holds one series, and series spread over the cluster by key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cycles import PHASES
from .series import KEY, ORDER


def gate_opening(df: DataFrame, gate: Column, anchor: Column, lead: float = 1.0) -> DataFrame:
    """Per series: the first sample from the anchor on with the gate open, and where cues may start."""
    opened = F.min(F.when(F.coalesce(gate, F.lit(False)) & (F.col(ORDER) >= anchor), F.col(ORDER)))
    out = df.groupBy(KEY).agg(opened.alias("opened"), F.max(anchor).alias("anchor"))
    return out.select(KEY, "opened", F.greatest(F.col("anchor"), F.col("opened") - lead).alias("cue_from"))


def axis(df: DataFrame, low: float = 0.1) -> DataFrame:
    """Per series: the median place (x, y) of the lowest tenth of heights while not over the target."""
    cut = df.groupBy(KEY).agg(F.percentile("height", F.lit(low)).alias("cut"))
    part = df.join(cut, KEY).where((F.col("height") <= F.col("cut")) & (F.coalesce("over", F.lit(0.0)) <= 0))
    return part.groupBy(KEY).agg(F.median("x").alias("pile_x"), F.median("y").alias("pile_y"))


def projected(df: DataFrame, axes: DataFrame) -> DataFrame:
    """`pos`: place along the line from the pile (0) to the origin (1)."""
    j = df.join(axes, KEY)
    dx, dy = -F.col("pile_x"), -F.col("pile_y")
    return j.withColumn("pos", F.try_divide((F.col("x") - F.col("pile_x")) * dx + (F.col("y") - F.col("pile_y")) * dy, dx * dx + dy * dy)).drop("pile_x", "pile_y")


def side(df: DataFrame) -> DataFrame:
    """+1 or -1 per series: the sign of the median x while over the target, +1 by default."""
    return df.groupBy(KEY).agg(F.when(F.coalesce(F.median(F.when(F.col("over") > 0, F.col("x"))), F.lit(0.0)) >= 0, 1).otherwise(-1).alias("side"))


def movement_start(df: DataFrame, windows: DataFrame, rate: str, noise: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Per window (series, a, b): where the movement that peaks in it began.

    The peak is the largest rate; if it is within `sigma` noises nothing moved (NULL). The start
    follows the last sample before the peak whose rate is inside the band or unknown; without
    one it is the window's first sample. A window is laid out by its own samples, so the join is on
    equal samples and each window costs its length."""
    laid = windows.select(KEY, "a", "b", F.explode(F.sequence("a", "b")).alias(ORDER))
    rows = df.select(KEY, ORDER, F.col(rate).alias("_v")).join(laid, [KEY, ORDER]).join(noise, KEY)
    per = Window.partitionBy(KEY, "a", "b")
    best = F.max(F.when(F.col("_v").isNotNull(), F.struct("_v", (-F.col(ORDER)).alias("n")))).over(per)
    rows = rows.withColumn("_p", best).withColumn("_apex", -F.col("_p.n"))
    band = F.col("noise") * sigma
    calm = F.max(F.when((F.col(ORDER) < F.col("_apex")) & (F.coalesce(F.col("_v"), F.lit(0.0)) <= band), F.col(ORDER)))
    out = rows.groupBy(KEY, "a", "b").agg(calm.alias("_calm"), F.min(ORDER).alias("_first"), F.max("_p._v").alias("peak"), F.max(band).alias("_band"))
    return out.select(KEY, "a", "b", "peak", F.when(F.col("peak") > F.col("_band"), F.coalesce(F.col("_calm") + 1, F.col("_first"))).alias("start"))


STARTS = "series string, nth int, phase string, time double, win_a double, win_b double, weak boolean, abandoned boolean, stop string"


def fold(events: list[tuple[str, float, float, float]], longest_wait: float) -> tuple[list[tuple], str | None]:
    """Phase windows in order over events (phase, a, b, strength), sorted by a.

    From the end of the last window the next phase takes its first event. If a strong first
    phase comes before it, or it is more than `longest_wait` away, the cycle is given up and the
    search goes on from that first phase. Without any event left the search stops there."""
    found: list[tuple] = []
    at, step = -np.inf, 0
    while True:
        phase = PHASES[step]
        mine = next((e for e in events if e[0] == phase and e[1] >= at), None)
        anew = next((e for e in events if e[0] == PHASES[0] and e[1] >= at and e[3] > 0.5), None) if step else None
        late = mine is not None and step > 0 and mine[1] - at > longest_wait
        if step and anew is not None and (mine is None or late or anew[1] < mine[1]):
            for k in range(len(found) - 1, len(found) - 1 - step, -1):
                found[k] = (*found[k][:-1], True)
            mine, step, phase = anew, 0, PHASES[0]
        elif mine is None or late:
            return found, phase
        found.append((phase, (mine[1] + mine[2]) / 2, mine[1], mine[2], mine[3] <= 0.5, False))
        at, step = mine[2] + 1e-3, (step + 1) % len(PHASES)


def phase_search(events: DataFrame, longest_wait: float = 1e9) -> DataFrame:
    """events (series, phase, a, b, strength) -> phase starts in order, with abandoned cycles and the stop."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b", "phase"])
        found, stop = fold(list(pdf[["phase", "a", "b", "strength"]].itertuples(index=False, name=None)), longest_wait)
        rows = [(pdf["series"].iloc[0], n, *f, None) for n, f in enumerate(found)]
        rows.append((pdf["series"].iloc[0], len(found), stop, None, None, None, None, None, stop))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STARTS.split(", ")])

    return events.groupBy("series").applyInPandas(run, STARTS)
