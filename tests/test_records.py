"""Track files both ways, expected answers with their errors, unequal clips, spacing, ranked medians and wide peaks."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadence.operators import checks, cycles, intervals, order_stats, patterns, series
from cadence.sources import records


def test_tracks_are_written_and_read_again(spark, tmp_path):
    names = [c.split()[0] for c in records.FRAME.split(", ")]
    rows = [("a", 1, 3, 0.1), ("a", 0, 0, 0.0), ("b", 0, 5, 0.0)]
    frames = spark.createDataFrame(rows, "clip string, sample long, frame_index long, time_seconds double")
    kinds = {c.split()[0]: c.split()[1] for c in records.FRAME.split(", ")}
    whole = frames.select("clip", "sample", *(F.col(c) if c in frames.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names))
    records.write_tracks(whole, str(tmp_path / "tracks"))
    back = records.read_tracks(spark, str(tmp_path / "tracks"))
    assert sorted((r.clip, r.sample, r.frame_index, r.time_seconds) for r in back.collect()) == sorted((c, s, f, t) for c, s, f, t in rows)


def test_expected_answers_say_what_is_wrong(spark, tmp_path):
    good = {"clip": "a", "scoring": {"tolerance_seconds": 0.6}, "expected_answer": {"cycle_count": 2, "average_cycle_duration_seconds": 24.5, "average_phase_duration_seconds": {"digging": True, "hauling": 1.5, "dumping": "2", "swinging": 1}}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{")
    got = {(r.clip, r.field.rsplit(".", 1)[-1]): (r.value, r.error) for r in records.read_expected(spark, str(tmp_path)).collect()}
    assert got["a", "tolerance_seconds"] == (0.6, None) and got["a", "cycle_count"] == (2.0, None) and got["a", "hauling"] == (1.5, None)
    assert got["a", "digging"] == (None, "not a number") and got["a", "dumping"] == (None, "not a number")
    assert got["b.json", "cycle_count"] == (None, "not an object") and got["c.json", "cycle_count"] == (None, "not JSON")


def test_settings_in_layers():
    defaults = {"a": 1, "b": {"c": 2, "d": 3}}
    assert records.layered(defaults, {"b": {"c": 5}}, {"a": 4}) == {"a": 4, "b": {"c": 5, "d": 3}}
    for wrong in ({"x": 1}, {"b": {"x": 1}}, {"b": 2}):
        with pytest.raises(ValueError, match="setting"):
            records.layered(defaults, wrong)


def test_unequal_clips_are_an_error_row(spark):
    rows = lambda n: [("a", float(k), "p") for k in range(3)] + [("b", float(k), "p") for k in range(n)]
    schema = "clip string, time double, phase string"
    out = cycles.zipped(spark.createDataFrame(rows(2), schema), spark.createDataFrame(rows(4), schema)).collect()
    assert sorted((r.clip, r.n, r.apart, r.error) for r in out if r.clip == "a") == [("a", 1, 0.0, None), ("a", 2, 0.0, None), ("a", 3, 0.0, None)]
    assert [(r.n, r.error) for r in out if r.clip == "b"] == [(None, "2 against 4")]


def test_spacing_refuses_what_has_none(spark):
    rows = [("even", i, i / 10) for i in range(9)] + [("one", 0, 0.0)] + [("still", i, 1.0) for i in range(4)] + [("jumps", i, t) for i, t in enumerate((0.0, 0.1, 0.2, 0.6))]
    got = {r.series: r for r in series.spacing(spark.createDataFrame(rows, "series string, i long, t double")).collect()}
    assert abs(got["even"].spacing - 0.1) < 1e-12 and got["even"].uniform and got["even"].error is None
    assert got["one"].error == "fewer than two samples" and got["still"].error == "times do not increase" and got["still"].spacing is None
    assert not got["jumps"].uniform and abs(got["jumps"].spread - 3) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_medians_and_minima_of_any_stretch(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 90))
    v = rng.integers(0, 9, n).astype(float)
    v[rng.random(n) < 0.2] = np.nan
    a, b = np.sort(rng.integers(0, n + 1, (2, 60)), axis=0)
    got = order_stats.Ranked(v).median(a, b)
    want = np.array([np.nanmedian(v[x:y]) if np.isfinite(v[x:y]).any() else np.nan for x, y in zip(a, b, strict=True)])
    assert np.array_equal(got, want, equal_nan=True)
    w = np.nan_to_num(v)
    lo, hi = np.minimum(a, n - 1), np.minimum(b, n - 1)
    assert order_stats.Least(w).at(lo, hi).tolist() == [x + int(np.argmin(w[x : y + 1])) for x, y in zip(lo, hi, strict=True)]
    assert order_stats.Least(w, last=True).at(lo, hi).tolist() == [y - int(np.argmin(w[x : y + 1][::-1])) for x, y in zip(lo, hi, strict=True)]
    before, behind = order_stats.next_higher(w)
    assert before.tolist() == [max((k for k in range(i) if w[k] > w[i]), default=-1) for i in range(n)]
    assert behind.tolist() == [min((k for k in range(i + 1, n) if w[k] > w[i]), default=n) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_peaks_against_a_plain_version(seed):
    rng = np.random.default_rng(seed)
    v = np.round(np.cumsum(rng.normal(size=200)), int(rng.integers(0, 3)))
    want, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i] > v[i - 1] and j < len(v) - 1 and v[j + 1] < v[i]:
            top = (i + j) // 2
            a, b = top, top
            low_a, low_b = top, top
            while a >= 0 and v[a] <= v[top]:
                low_a = a if v[a] < v[low_a] else low_a
                a -= 1
            while b < len(v) and v[b] <= v[top]:
                low_b = b if v[b] < v[low_b] else low_b
                b += 1
            rise = v[top] - max(v[low_a], v[low_b])
            if rise >= 1.0:
                level = v[top] - rise / 2
                x, y = top, top
                while x > low_a and v[x] > level:
                    x -= 1
                while y < low_b and v[y] > level:
                    y += 1
                want.append((top, low_a, low_b, x + ((level - v[x]) / (v[x + 1] - v[x]) if v[x] < level else 0.0), y - ((level - v[y]) / (v[y - 1] - v[y]) if v[y] < level else 0.0)))
        i = j + 1
    found = patterns.peaks(v, 1.0)
    got = [(t, a, b, lo, hi) for (t, _, a, b), (_, lo, hi) in zip(found, patterns.widths(v, found), strict=True)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want])


def test_a_long_series_is_a_matter_of_seconds(spark):
    n = 100_000
    rng = np.random.default_rng(0)
    t = np.arange(n)
    rows = pd.DataFrame({"series": "s", "i": t, "height": np.sin(t / 50) * 40 + 50 + rng.normal(0, 3, n), "side": 1, "truck_overlap": 0.0})
    for c in ("bucket_x", "rel_cabin_x", "rel_truck_x", "rel_cabin_y", "rel_truck_y"):
        rows[c] = rng.normal(size=n)
    df = spark.createDataFrame(rows)
    phase = F.element_at(F.array(*map(F.lit, cycles.PHASES)), (F.col("i") / 100 % 4 + 1).cast("int"))
    labels = df.where("i % 100 = 0").select("series", F.col("i").alias("truth"), phase.alias("phase"))
    began = time.monotonic()
    got = checks.first_matches_ruled(df, F.col("height") > 60, labels, "hauling", 2).collect()
    assert len(got) == 250 and sum(r.a is not None for r in got) > 200 and time.monotonic() - began < 60
    peaks = patterns.peaks(rows["height"].to_numpy(), 10.0)
    assert len(peaks) > 100


def test_what_overlaps_nothing(spark):
    rng = np.random.default_rng(2)
    make = lambda n: sorted({(int(a), int(a + w)) for a, w in zip(rng.integers(0, 400, n), rng.integers(0, 6, n), strict=True)})
    left, right = make(60), make(40)
    df = lambda rows: spark.createDataFrame([("s", a, b) for a, b in rows] or [], "series string, a long, b long")
    want = [(a, b) for a, b in left if not any(a <= d and b >= c for c, d in right)]
    assert sorted((r.a, r.b) for r in intervals.not_overlapping(df(left), df(right)).collect()) == want
    assert intervals.not_overlapping(df(left), df([])).count() == len(left)
