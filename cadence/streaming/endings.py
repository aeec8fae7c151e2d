"""What a series leaves open when it ends: losses not found again, phases not reached.

Online, a series has ended when nothing came from it for `patience` of event time; a timer says
so. A row that belongs to no series (series NULL) only moves the watermark on, so one such row
far enough ahead ends the input. Samples wait in state until the watermark has passed them, so
they are read in order whatever order they came in; besides these, state per series is one open
loss, the last phase and the last time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cadence.operators import patterns

#: fixed values: the order of the phases, and why a search stops
NEXT = {"digging": "hauling", "hauling": "dumping", "dumping": "swinging", "swinging": "digging"}
NO_DIG = "no dig found after this point: the clip may end before another cycle starts"
NO_STAGE = "the clip may end before this stage"


def why(phase: str | None) -> str:
    """Why nothing follows the last phase found (None: no phase yet)."""
    return NO_DIG if phase in (None, "swinging") else NO_STAGE


def why_column(phase: Column) -> Column:
    return F.when(phase.isNull() | (phase == "swinging"), NO_DIG).otherwise(NO_STAGE)


def endings(samples: DataFrame, least: float, step: float = 1.0) -> DataFrame:
    """Of whole series (series, i, missing, phase): losses of at least `least`, `open` if the series ends in one, and where it stops.

    (series, kind, a, b, open, expected, why): kind 'lost', or 'stop' with the phase expected next."""
    last = samples.groupBy("series").agg(F.max("i").alias("last"), F.max_by("phase", F.when(F.col("phase").isNotNull(), F.col("i"))).alias("phase"))
    none = F.lit(None).cast("string")
    lost = patterns.lost_spans(samples, F.col("missing"), least, step).join(last, "series")
    lost = lost.select("series", F.lit("lost").alias("kind"), "a", "b", (F.col("b") == F.col("last")).alias("open"), none.alias("expected"), none.alias("why"))
    following = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in NEXT.items() for x in pair)), F.col("phase")), F.lit("digging"))
    stops = last.select("series", F.lit("stop").alias("kind"), F.col("last").alias("a"), F.col("last").alias("b"), F.lit(True).alias("open"), following.alias("expected"), why_column(F.col("phase")).alias("why"))
    return lost.union(stops)


class _Ending(StatefulProcessor):
    def __init__(self, least_ms: int, step_ms: int, patience_ms: int):
        self.least, self.step, self.patience = least_ms, step_ms, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.loss = handle.getValueState("loss", "a long, b long")
        self.seen = handle.getValueState("seen", "last long, phase string")
        self.waiting = handle.getMapState("waiting", "t long", "missing boolean, phase string")

    def _read(self, key: tuple, upto: int | None) -> list[tuple]:
        """Losses that the samples before `upto` end (None: all that wait), in order of time."""
        out = []
        a, b = self.loss.get() if self.loss.exists() else (-1, -1)
        last, phase = self.seen.get() if self.seen.exists() else (-1, None)
        times = sorted(t for (t,) in self.waiting.keys()) if self.waiting.exists() else []
        for t in times:
            if upto is not None and t >= upto:
                break
            missing, named = self.waiting.getValue((t,))
            self.waiting.removeKey((t,))
            if missing:
                a, b = (t, t) if a < 0 else (a, t)
            elif a >= 0:
                if b - a + self.step >= self.least:
                    out.append((key[0], "lost", a, b, False, None, None))
                a = b = -1
            last, phase = t, named or phase
        self.loss.update((a, b))
        self.seen.update((last, phase))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = -1
        for batch in rows:
            if key[0] is None:
                continue
            times = (batch["t"].astype("datetime64[ms]").astype("int64")).tolist()
            for t, missing, phase in zip(times, batch["missing"].tolist(), batch["phase"].tolist(), strict=True):
                self.waiting.updateValue((t,), (bool(missing), phase if isinstance(phase, str) else None))
                newest = max(newest, t)
        if newest < 0:
            return
        out = self._read(key, timerValues.getCurrentWatermarkInMs())
        due = [t for t in self.handle.listTimers()]
        if not due or max(due) < newest + self.patience:
            for t in due:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(newest + self.patience)
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._read(key, None)
        a, b = self.loss.get()
        last, phase = self.seen.get()
        if a >= 0 and b - a + self.step >= self.least:
            out.append((key[0], "lost", a, b, True, None, None))
        out.append((key[0], "stop", last, last, True, NEXT.get(phase, "digging"), why(phase)))
        yield _rows(out)

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    rows = pd.DataFrame(out, columns=["series", "kind", "a", "b", "open", "expected", "why"])
    return rows.astype({"a": "int64", "b": "int64", "open": "bool"})


def endings_online(samples: DataFrame, least: float, patience: float, step: float = 1.0, delay: str = "0 seconds") -> DataFrame:
    """`endings` of a stream (series, t timestamp, missing, phase); a and b are timestamps, times in seconds.

    Closed losses come out as the watermark passes them. A series that was silent for `patience`
    gives its open loss and its stop; if it goes on after that, its loss goes on too, and comes
    out again, with its end, when it closes. Of rows with equal times the last counts."""
    stream = samples.withWatermark("t", delay)
    kind = "series string, kind string, a long, b long, open boolean, expected string, why string"
    done = stream.groupBy("series").transformWithStateInPandas(_Ending(round(least * 1000), round(step * 1000), round(patience * 1000)), kind, "append", "eventTime")
    return done.select("series", "kind", F.timestamp_millis("a").alias("a"), F.timestamp_millis("b").alias("b"), "open", "expected", "why")
