"""Per-frame mask operators that are not relational: components, geodesic distance, seed points.

A frame's mask is small and whole; frames are many. So each runs as a grouped Pandas function
with one group per (clip, sample), and NumPy works on the frame's pixels; the geodesic distance,
which every frame needs, takes many frames at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def _grid(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The pixels as a bitmap with an empty border, and its origin."""
    oy, ox = int(y.min()) - 1, int(x.min()) - 1
    out = np.zeros((int(y.max()) - oy + 2, int(x.max()) - ox + 2), bool)
    out[y - oy, x - ox] = True
    return out, oy, ox


def _around(front: np.ndarray) -> np.ndarray:
    """All pixels next to (or in) the front, corners included."""
    out = front.copy()
    out[1:] |= front[:-1]
    out[:-1] |= front[1:]
    side = out.copy()
    out[:, 1:] |= side[:, :-1]
    out[:, :-1] |= side[:, 1:]
    return out


def label(mask: np.ndarray) -> np.ndarray:
    """Number of the 8-connected component of each pixel, from 1; 0 outside."""
    out = np.zeros(mask.shape, np.int64)
    left, n = mask.copy(), 0
    while left.any():
        n += 1
        front = np.zeros_like(mask)
        front[np.unravel_index(np.argmax(left), mask.shape)] = True
        while True:
            grown = _around(front) & left
            if (grown == front).all():
                break
            front = grown
        out[front] = n
        left &= ~front
    return out


def grown_components(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """The number of each pixel's 8-connected component, from 0."""
    grid, oy, ox = _grid(ys, xs)
    return label(grid)[ys - oy, xs - ox] - 1


def geodesic(mask: np.ndarray, y: int, x: int, most: int = 1999) -> np.ndarray:
    """Steps to each pixel inside the mask from the pixel nearest to (y, x); -1 where none leads."""
    out = np.full(mask.shape, -1, np.int64)
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return out
    k = int(np.argmin((ys - y) ** 2 + (xs - x) ** 2))
    front = np.zeros_like(mask)
    front[ys[k], xs[k]] = True
    out[front] = 0
    for step in range(1, most + 1):
        new = _around(front) & mask & (out < 0)
        if not new.any():
            break
        out[new] = step
        front = new
    return out


#: fixed values: what a step to the next pixel and one across a corner count in the depth
STRAIGHT, ACROSS = 0.955, 1.3693


def depth(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the outside, in straight and diagonal steps: one pass down, one up."""
    far = float(sum(mask.shape)) * ACROSS
    out = np.where(np.pad(mask, 1), far, 0.0)

    def sweep(rows: np.ndarray) -> None:
        """Each row from the one before it, then along the row both ways; in place."""
        along = STRAIGHT * np.arange(rows.shape[1])
        for y in range(len(rows)):
            row = rows[y]
            if y:
                above = rows[y - 1]
                row = np.minimum(row, above + STRAIGHT)
                row[1:] = np.minimum(row[1:], above[:-1] + ACROSS)
                row[:-1] = np.minimum(row[:-1], above[1:] + ACROSS)
            row = np.minimum.accumulate(row - along) + along
            rows[y] = (np.minimum.accumulate((row + along)[::-1])[::-1]) - along
    sweep(out)
    sweep(out[::-1])
    return np.round(out[1:-1, 1:-1], 9)


def spread_points(mask: np.ndarray, k: int, least: int = 25) -> list[tuple[int, int]]:
    """k points deep inside a mask and far from one another, chosen greedily: depth times (1 + distance to those chosen).

    A mask below `least` pixels has none; of equals the first by row, then column, is taken."""
    ys, xs = np.nonzero(mask)
    if len(ys) < least:
        return []
    deep = depth(mask)[ys, xs]
    far = np.full(len(ys), np.inf)
    out: list[tuple[int, int]] = []
    for _ in range(min(k, len(ys))):
        pick = int(np.argmax(np.round(deep * (1.0 + far), 9) if out else deep))
        out.append((int(ys[pick]), int(xs[pick])))
        far = np.minimum(far, np.hypot(ys - ys[pick], xs - xs[pick]))
        deep[pick] = -1.0
    return out


def large_components(pixels: DataFrame, least: float = 0.05) -> DataFrame:
    """Pixels of components with at least `least` of the mask's area; all of them if none is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        grid, oy, ox = _grid(y, x)
        at = label(grid)[y - oy, x - ox]
        share = np.bincount(at) / len(at)
        keep = share[at] >= least
        return pdf if not keep.any() else pdf[keep]

    return pixels.select("clip", "sample", "y", "x").distinct().groupBy("clip", "sample").applyInPandas(run, pixels.select("clip", "sample", "y", "x").schema)


#: pixels that are walked at a time, or one frame if it has more
WALKED = 200_000


def few_clips(pixels: DataFrame, most: int = 100_000) -> bool:
    """Whether a table with one row per clip is small, by count."""
    return pixels.select("clip").distinct().limit(most + 1).count() <= most


def with_clip(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """rows with their clip's facts (one row per clip); those of few clips are sent to the rows, which would meet in few tasks."""
    return rows.join(F.broadcast(facts) if few else facts, "clip")


def _neighbours(at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For every pixel the numbers of the up to eight next to it, -1 where there is none; `at`: ascending places in bitmaps of `width`, borders empty."""
    n = len(at)
    ends = np.append(at, -1)
    out = np.full((n, 8), -1, np.int64)
    out[1:, 0][at[1:] - at[:-1] == 1] = np.flatnonzero(at[1:] - at[:-1] == 1)
    out[:-1, 1][at[1:] - at[:-1] == 1] = np.flatnonzero(at[1:] - at[:-1] == 1) + 1
    for column, row in ((2, at - width), (5, at + width)):
        k = np.searchsorted(at, row - 1)
        for dx in (-1, 0, 1):
            hit = ends[k] == row + dx
            out[hit, column + dx + 1] = k[hit]
            k += hit
    return out


def walked(frame: np.ndarray, y: np.ndarray, x: np.ndarray, sy: np.ndarray, sx: np.ndarray, most: int = 1999) -> np.ndarray:
    """`geodesic` in many masks: pixels in order of frame (numbered from 0), y, x, each once; every mask's walk takes its step at the same time."""
    first = np.flatnonzero(np.diff(frame, prepend=-1))
    low, width = np.minimum.reduceat(x, first) - 1, np.maximum.reduceat(x, first) - np.minimum.reduceat(x, first) + 3
    top, height = y[first] - 1, y[np.append(first[1:], len(y)) - 1] - y[first] + 3
    base = np.cumsum(width * height) - width * height
    at = base[frame] + (y - top[frame]) * width[frame] + x - low[frame]
    near = _neighbours(at, width[frame])
    d = (y - sy) ** 2 + (x - sx) ** 2
    nearest = np.flatnonzero(d == np.minimum.reduceat(d, first)[frame])
    front = nearest[np.flatnonzero(np.diff(frame[nearest], prepend=-1))]
    steps, mark = np.full(len(y), -1, np.int64), np.empty(len(y), np.int64)
    steps[front] = 0
    for step in range(1, most + 1):
        new = near[front].ravel()
        new = new[new >= 0]
        new = new[steps[new] < 0]
        if not len(new):
            break
        steps[new] = step
        mark[new] = np.arange(len(new))
        front = new[mark[new] == np.arange(len(new))]
    return steps


def _frames(rows: pa.Table) -> np.ndarray:
    """The number of each row's frame, from 0, in rows sorted by frame."""
    new = np.zeros(len(rows), bool)
    for c in (rows["clip"], pc.is_null(rows["sample"]), pc.fill_null(rows["sample"], 0)):
        c = c.combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by frame, in tables of whole frames, with the frames' numbers."""
    held, size, least = [], 0, WALKED
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= least:
            rows = pa.Table.from_batches(held)
            frame = _frames(rows)
            last = int(np.searchsorted(frame, frame[-1]))
            if last:
                yield rows[:last], frame[:last]
            held, size = rows[last:].combine_chunks().to_batches(), len(rows) - last
            least = max(WALKED, 2 * size)
    if size:
        rows = pa.Table.from_batches(held)
        yield rows, _frames(rows)


def by_frame(pixels: DataFrame) -> DataFrame:
    """The pixels shuffled by frame; all that starts from this shares one shuffle."""
    return pixels.select("clip", "sample", "y", "x").repartition("clip", "sample")


def geodesic_distance(pixels: DataFrame, seeds: DataFrame, few: bool | None = None, share: float = 0.0) -> DataFrame:
    """pixels with `steps` from the clip's seed (sy, sx) inside the mask, and the frame's `reach`, the most steps; pixels out of reach are left out.

    Frames are shuffled and sorted once, and walked some thousand at a time. few: whether the
    clips are few, if that is known. share: only pixels at that share of the reach or beyond are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, frame in _whole_frames(batches):
            if rows["y"].null_count or rows["x"].null_count:
                there = pc.and_(pc.is_valid(rows["y"]), pc.is_valid(rows["x"]))
                rows, frame = rows.filter(there), frame[there.to_numpy()]
            if not len(rows):
                continue
            y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
            once = np.ones(len(rows), bool)
            once[1:] = (np.diff(frame) != 0) | (np.diff(y) != 0) | (np.diff(x) != 0)
            rows, frame = rows.filter(pa.array(once)), np.cumsum(np.diff(frame[once], prepend=frame[0]) != 0)
            steps = walked(frame, y[once], x[once], rows["sy"].to_numpy(), rows["sx"].to_numpy())
            reach = np.maximum.reduceat(steps, np.flatnonzero(np.diff(frame, prepend=-1)))[frame]
            out = rows.select(["clip", "sample", "y", "x"]).append_column("steps", pa.array(steps)).append_column("reach", pa.array(reach))
            yield from out.filter(pa.array((steps >= 0) & (steps >= share * reach))).combine_chunks().to_batches()

    kind = pixels.schema["clip"].dataType.simpleString()
    long = [F.col(c).cast("long").alias(c) for c in ("sample", "y", "x", "sy", "sx")]
    few = few_clips(pixels) if few is None else few
    rows = with_clip(by_frame(pixels) if few else pixels, seeds, few).select("clip", *long)
    if not few:  # the join may have dealt the rows out by clip
        rows = rows.repartition("clip", "sample")
    # by sample first: it tells more rows apart than the clip
    return rows.sortWithinPartitions("sample", "clip", "y", "x").mapInArrow(run, f"clip {kind}, sample long, y long, x long, steps long, reach long")


def bands(distances: DataFrame, far: float = 0.82, middle: tuple[float, float] = (0.5, 0.75)) -> DataFrame:
    """Pixels of the far end and of the middle part of the frame's reach, by geodesic distance."""
    at = lambda share: F.col("steps") >= share * F.col("reach")
    name = F.when(at(far), "far").when(at(middle[0]) & ~at(middle[1]), "middle")
    return distances.where("reach > 0").withColumn("band", name).where("band is not null")


def interior_points(pixels: DataFrame, k: int = 5, least: int = 25) -> DataFrame:
    """(clip, sample, nth, y, x): k points deep inside each mask of at least `least` pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, oy, ox = _grid(pdf["y"].to_numpy(), pdf["x"].to_numpy())
        rows = [(pdf["clip"].iloc[0], pdf["sample"].iloc[0], n, y + oy, x + ox) for n, (y, x) in enumerate(spread_points(grid, k, least))]
        return pd.DataFrame(rows, columns=["clip", "sample", "nth", "y", "x"])

    kind = pixels.schema["clip"].dataType.simpleString()
    return pixels.select("clip", "sample", "y", "x").distinct().groupBy("clip", "sample").applyInPandas(run, f"clip {kind}, sample long, nth long, y long, x long")


def grid_points(boxes: DataFrame, rows: int = 2, columns: int = 3, y: tuple[float, float] = (0.55, 0.9), margin: float = 0.15) -> DataFrame:
    """A rows x columns grid of points inside each box, kept off its sides."""
    at = lambda lo, hi, k, n: lo + (hi - lo) * k / max(n - 1, 1)
    spots = [(at(*y, r, rows), at(margin, 1 - margin, c, columns)) for r in range(rows) for c in range(columns)]
    points = F.array(*(F.struct((F.col("y0") + v * (F.col("y1") - F.col("y0"))).alias("py"), (F.col("x0") + u * (F.col("x1") - F.col("x0"))).alias("px")) for v, u in spots))
    return boxes.select("clip", F.posexplode(points).alias("nth", "p")).select("clip", "nth", "p.py", "p.px")
