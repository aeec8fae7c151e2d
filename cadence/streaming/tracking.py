"""Following an object from one seed sample, onward and back, with bounded memory.

A seed splits a series (or the stretch it is for) into two legs: the samples from the seed on, and those from the seed back.
Each leg is a stream of its own in which time runs forward, so one fold serves both. A tracker
sees one frame at a time, the anchor (the seed's own output, never forgotten) and the last
outputs; it gives an output (a list of numbers, empty where nothing was found) and a confidence.

`tracked` is the batch form: legs are shuffled by (series, seed, leg), sorted by step, and folded in
order, with one frame and `window` outputs in memory. `tracked_online` is the same fold as a
stateful operator of a stream: state per leg is the anchor, the last outputs and the frames that
came early, whatever the stream's length.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


@dataclass
class Memory:
    """What a tracker may look at: the anchor, and the last outputs, oldest first."""

    window: int
    anchor: list[float] | None = None
    recent: list[list[float]] = field(default_factory=list)

    def keep(self, output: list[float]) -> None:
        """The first output is the anchor; of the others the last `window - 1` stay, so that with the next one there are `window`."""
        if self.anchor is None:
            self.anchor = output
        else:
            self.recent.append(output)
            del self.recent[: max(0, len(self.recent) - self.window + 1)]


#: (frame, memory) -> (output, confidence); the memory has no anchor yet on the seed's own frame
Tracker = Callable[[dict, Memory], tuple[list[float], float]]


def reach(longest_mask_memory: int = 7, longest_pointers: int = 16) -> int:
    """Outputs to keep: twice as many as the tracker looks back on."""
    return 2 * max(longest_mask_memory, longest_pointers)


def legs(frames: DataFrame, seeds: DataFrame) -> DataFrame:
    """frames (series, i, ...) with seed, leg and step, from the seeds' (series, seed) out to first and last.

    Without columns `first` and `last` a seed reaches the whole series. A seed on its first sample has no way back."""
    limits = [F.col(c) if c in seeds.columns else F.lit(None).cast("long").alias(c) for c in ("first", "last")]
    inside = (F.col("i") >= F.coalesce("first", "i")) & (F.col("i") <= F.coalesce("last", "i"))
    rows = frames.join(seeds.select("series", "seed", *limits), "series").where(inside)
    on = F.when(F.col("i") >= F.col("seed"), F.struct(F.lit("forward").alias("leg"), (F.col("i") - F.col("seed")).alias("step")))
    back = F.when((F.col("i") <= F.col("seed")) & (F.col("seed") > F.coalesce("first", F.col("seed") - 1)), F.struct(F.lit("backward").alias("leg"), (F.col("seed") - F.col("i")).alias("step")))
    return rows.withColumn("way", F.explode(F.array_compact(F.array(on, back)))).select("*", "way.leg", "way.step").drop("way", "first", "last")


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["series", "i", "leg", "step", "output", "confidence"]).astype({"i": "int64", "step": "int64", "confidence": "float64"})


def _schema(frames: DataFrame) -> str:
    return f"series {frames.schema['series'].dataType.simpleString()}, i long, leg string, step long, output array<double>, confidence double"


def tracked(frames: DataFrame, seeds: DataFrame, tracker: Tracker, window: int = reach(), keep_empty: bool = True) -> DataFrame:
    """(series, i, output, confidence): each sample once, the seed's from its way forward.

    Without `keep_empty`, an output in which nothing was found is NULL; its confidence stays."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, memory = None, Memory(window)
        for rows in batches:
            out = []
            for frame in rows.to_dict("records"):
                leg = (frame["series"], frame["seed"], frame["leg"])
                if leg != at:
                    at, memory = leg, Memory(window)
                output, confidence = tracker(frame, memory)
                memory.keep(output)
                out.append((frame["series"], frame["i"], frame["leg"], frame["step"], output, confidence))
            yield _told(out)

    rows = legs(frames, seeds)
    done = rows.repartition("series", "seed", "leg").sortWithinPartitions("series", "seed", "leg", "step").mapInPandas(fold, _schema(frames))
    return once(done, keep_empty)


def once(done: DataFrame, keep_empty: bool = True) -> DataFrame:
    """The seed's sample from its way forward only."""
    output = F.col("output") if keep_empty else F.when(F.size("output") > 0, F.col("output"))
    return done.where("leg = 'forward' or step > 0").select("series", "i", output.alias("output"), "confidence")


class _Following(StatefulProcessor):
    """The fold of one leg; a frame that comes before its turn waits."""

    def __init__(self, tracker: Tracker, window: int):
        self.tracker, self.window = tracker, window

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "step long")
        self.anchor = handle.getValueState("anchor", "output array<double>")
        self.recent = handle.getListState("recent", "output array<double>")
        self.early = handle.getMapState("early", "step long", "frame string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        series, _, leg = key
        step = self.next.get()[0] if self.next.exists() else 0
        memory = Memory(self.window)
        if self.anchor.exists():
            memory.anchor = list(self.anchor.get()[0])
            memory.recent = [list(x[0]) for x in self.recent.get()]
        now = {}
        for batch in rows:
            now.update((frame["step"], frame) for frame in json.loads(batch.to_json(orient="records", double_precision=15)))
        waited = {k for (k,) in self.early.keys()} if self.early.exists() else set()
        out = []
        while step in now or step in waited:
            if step in now:
                frame = now.pop(step)
            else:
                frame = json.loads(self.early.getValue((step,))[0])
                self.early.removeKey((step,))
                waited.discard(step)
            output, confidence = self.tracker(frame, memory)
            memory.keep(output)
            out.append((series, frame["i"], leg, step, output, confidence))
            step += 1
        for later, frame in now.items():
            if later > step:
                self.early.updateValue((later,), (json.dumps(frame),))
        self.next.update((step,))
        if memory.anchor is not None:
            self.anchor.update((memory.anchor,))
            if memory.recent:
                self.recent.put([(x,) for x in memory.recent])
        yield _told(out)

    def close(self) -> None:
        pass


def tracked_online(frames: DataFrame, seeds: DataFrame, tracker: Tracker, window: int = reach(), keep_empty: bool = True) -> DataFrame:
    """`tracked` over a stream of frames whose samples are numbered without gaps, in any order; seeds are known before.

    A sample that comes again is passed over."""
    done = legs(frames, seeds).groupBy("series", "seed", "leg").transformWithStateInPandas(_Following(tracker, window), _schema(frames), "append", "none")
    return once(done, keep_empty)


def blend(column: str, own: float = 0.5, late: float = 0.6) -> Tracker:
    """A tracker of one number: `own` of the frame's value, the rest a blend of the mean of the last outputs (`late`) and the anchor."""

    def follow(frame: dict, memory: Memory) -> tuple[list[float], float]:
        value = frame[column]
        value = None if value is None or value != value else float(value)
        if memory.anchor is None:
            return ([] if value is None else [value]), float(value is not None)
        past = [x[0] for x in memory.recent if x]  # added in order, without the compensation of sum()
        base = memory.anchor[0] if memory.anchor else 0.0
        base = late * (reduce(add, past) / len(past) if past else base) + (1 - late) * base
        return [base if value is None else own * value + (1 - own) * base], 0.5 if value is None else 1 / (1 + abs(value - base))

    return follow
