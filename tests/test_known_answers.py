"""Small hand-checked cases for the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import geometry as geo
from cadence.operators import cycles, intervals, patterns, search, series, tracks


def frame(spark, values, name="s"):
    return spark.createDataFrame([(name, k, None if v is None else float(v)) for k, v in enumerate(values)], "series string, i long, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def ramp(*knots, step=0.2):
    t = np.arange(knots[0][0], knots[-1][0] + step / 2, step)
    return np.interp(t, [k[0] for k in knots], [k[1] for k in knots])


def test_moving_average(spark):
    df = frame(spark, [0, 10, 20, 30, 40])
    assert column(df.withColumn("m", series.moving_average("v", 3)), "m")[3] == 20
    assert column(df.withColumn("m", series.moving_average("v", 3, "leading")), "m")[1] == 20
    assert column(df.withColumn("m", series.moving_average("v", 3, "centred")), "m")[2] == 20
    assert column(frame(spark, [1, None, 3, 5]).withColumn("m", series.moving_average("v", 3)), "m")[2] == 2
    sparse = column(frame(spark, [1, 2, None, None, None, None, 7, 8]).withColumn("m", series.moving_average("v", 5)), "m")
    assert sparse[5] is None and sparse[0] == 1
    assert series.window_samples(0.25, 0.1) == 2 and series.window_samples(0.36, 0.1) == 4


def test_window_rounding_is_half_even():
    assert [series.window_samples(s, 1.0) for s in (0.4, 1.5, 2.5, 3.5)] == [1, 2, 2, 4]
    assert series.frame(4, "centred") == (-1, 2) and series.frame(5, "centred") == (-2, 2)


def test_derivative(spark):
    t = np.arange(60)
    rate = column(series.derivative(frame(spark, 3 + 2 * t + 0.5 * t**2), "v", "r", 4), "r")
    assert np.allclose(rate, 2 + t)  # a quadratic is differentiated exactly, ends included
    gap = column(series.derivative(frame(spark, [None] * 10 + list(range(30))), "v", "r", 4), "r")
    assert gap[:10] == [None] * 10 and all(x is not None for x in gap[10:])
    inner = column(series.derivative(frame(spark, [*range(18), None, None, None, *range(21, 40)]), "v", "r", 4), "r")
    assert np.allclose(inner, 1)
    assert column(series.derivative(frame(spark, range(9)), "v", "r", 4), "r") == [None] * 9


def test_noise_and_median(spark):
    rng = np.random.default_rng(0)
    steps = np.where(np.arange(400) > 200, 1.0, 0.0) + rng.normal(0, 0.01, 400)
    noise = series.noise_scale(frame(spark, steps)).first().noise
    assert 0.007 < noise < 0.012
    assert column(series.expanding_median(frame(spark, [0, 1, 2, 3, 100]), "v", "m"), "m") == [None, 0, 0.5, 1, 1.5]


def test_drop_knee_excursion(spark):
    drop = series.with_spread(frame(spark, ramp((0, 2), (10, 2), (11, 1), (20, 1))))
    found = patterns.big_drops(drop, rest=0.02).collect()
    assert len(found) == 1 and abs(found[0].onset - 50) <= 1 and abs(found[0].bottom - 55) <= 1 and found[0].drop > 0.9
    assert patterns.big_drops(series.with_spread(frame(spark, ramp((0, 2), (5, 2), (15, 1), (20, 1)))), rest=0.001, longest=12.5).count() == 0
    bend = series.side_changes(series.with_spread(frame(spark, ramp((0, 0), (10, 0), (14, 1), (20, 1)))), "v", 10)
    knees = patterns.runs(bend, patterns.knee("rising")).collect()
    assert len(knees) == 1 and knees[0].a <= 50 <= knees[0].b
    straight = series.side_changes(series.with_spread(frame(spark, ramp((0, 0), (20, 1)))), "v", 10)
    assert patterns.runs(straight, patterns.knee("rising")).count() == 0
    dip = series.with_spread(frame(spark, ramp((0, 0), (8, 0), (10, -1), (12, 0), (20, 0))))
    r = patterns.excursions(dip, direction="dip").collect()
    assert [(x.start, x.apex, x.finish) for x in r] == [(40, 50, 60)]
    both = series.with_spread(frame(spark, ramp((0, 0), (2, 0), (3, -0.2), (4, 0), (8, 0), (10, -1), (12, 0), (20, 0))))
    assert patterns.excursions(both, direction="dip").count() == 1


def test_peaks_by_definition():
    assert patterns.peaks(np.array([0, 1, 3, 1, 2, 0.5, 4, 0.0]), 0.0) == [(2, 2.5, 0, 5), (4, 1.0, 3, 5), (6, 4.0, 0, 7)]
    assert [p[0] for p in patterns.peaks(np.array([0, 2, 2, 2, 1, 5, 5.0]), 0.0)] == [2]


def test_lost_spans_and_missing(spark):
    rows = spark.createDataFrame([(True, 0.9), (False, 0.9), (True, 0.2), (None, None), (True, float("nan")), (True, 0.9)], "has_mask boolean, confidence double")
    assert [r.m for r in rows.select(tracks.missing().alias("m")).collect()] == [False, True, True, True, False, False]
    v = [1] * 10 + [None] * 10 + [1] * 5 + [None] * 9 + [1] + [None] * 15
    got = patterns.lost_spans(frame(spark, v), F.col("v").isNull(), 1.0, 0.1).orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [(10, 19), (35, 49)]


def test_boxes(spark):
    rows = [((10, 10, 20, 20), (0, 0, 100, 100), 1.0), ((0, 0, 10, 10), (50, 50, 60, 60), 0.0), ((0, 0, 10, 10), (5, 0, 50, 10), 66 / 121), ((10, 0, 20, 10), (0, 0, 10, 50), 11 / 121), ((10, 10, 20, 10), (0, 0, 100, 100), 1.0), ((7, 7, 7, 7), (0, 0, 10, 10), 1.0)]
    names = [f"{s}{c}" for s in "ab" for c in ("x0", "y0", "x1", "y1")]
    df = spark.createDataFrame([tuple(map(float, a + b)) for a, b, _ in rows], names)
    got = df.select(geo.overlap_fraction(geo.box("a"), geo.box("b")).alias("o"), geo.aspect_ratio(geo.box("a")).alias("r")).collect()
    assert np.allclose([g.o for g in got], [r[2] for r in rows])
    assert got[0].r == 1.0


def test_rle_round_trip(spark):
    rng = np.random.default_rng(4)
    masks = {"empty": np.zeros(20, bool), "full": np.ones(20, bool), "starts": np.array([True, False, True]), "random": rng.random(500) < 0.4}
    rows = [(k, i, bool(x)) for k, m in masks.items() for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "key string, nr int, hit boolean")
    enc = geo.rle_encode(df, "key", "nr", F.col("hit"))
    assert {r.key: r.rle for r in enc.collect()}["starts"] == [0, 1, 1, 1]
    got = {}
    for r in geo.rle_decode(enc, "key").collect():
        got.setdefault(r.key, set()).add(r.pos)
    assert all(got.get(k, set()) == set(np.flatnonzero(m)) for k, m in masks.items())


def test_votes_and_asof(spark):
    samples = frame(spark, range(6))
    spans = spark.createDataFrame([("s", 1, 3, 2), ("s", 3, 4, 1)], "series string, a long, b long, weight int")
    voted = intervals.votes(samples, spans)
    assert column(voted, "votes") == [0, 2, 2, 3, 1, 0]
    assert intervals.majority(voted, 3.0).first()[1:] == (1, 3, False)
    left = spark.createDataFrame([("k", 5), ("k", 1), ("x", 1)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 9, "c")], "k string, u int, w string")
    assert {(r.k, r.t): r.w for r in intervals.asof_latest(left, right, "k", "t", "u", ["w"]).collect()} == {("k", 5): "b", ("k", 1): None, ("x", 1): None}


PHASE = dict(zip("DHPS", cycles.PHASES, strict=True))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("D2 H5 P9 S12 D17", (1, 15, 3, 4, 3, 5)),
        ("D2 H5 P9 S12", (0, 0, 0, 0, 0, 0)),
        ("S0.5 D2 H5 P9 S12 D17 H20", (1, 15, 3, 4, 3, 5)),
        ("D2 H5 D17 H20 P24 S27 D32", (1, 15, 3, 4, 3, 5)),
        ("D2 H5 S12 D17", (1, 15, 3, 0, 0, 5)),
        ("D2 P5 H9 D17", (0, 0, 0, 0, 0, 0)),
        ("D0 H2 P6 S8 D12 H16 S22 D30", (2, 15, 3, 4, 2, 6)),
        ("D0 H2 P6 S8 D12 H16 P18 S22 D30", (2, 15, 3, 3, 3, 6)),
        ("D4.804 H10.509 P20.618 S22.820 D29.526", (1, 24.722, 5.705, 10.109, 2.202, 6.706)),
        ("D1.000 H8.003 P15.605 S18.206 D25.009 H30.611 P41.014 S43.215 D50.218 H60.421 P68.624 S71.825 D79.228", (3, 26.076, 7.603, 8.736, 2.668, 7.070)),
    ],
)
def test_cycles(spark, text, expected):
    starts = spark.createDataFrame([("c", PHASE[w[0]], float(w[1:])) for w in text.split()], "clip string, phase string, time double")
    row = cycles.averages(cycles.assemble(starts), starts).first()
    assert tuple(row)[1:] == pytest.approx(expected, abs=2e-3)


def test_scores(spark):
    answer = spark.createDataFrame([("c", '{"cycle_count":1,"average_cycle_duration_seconds":10.6}'), ("d", "not json")], "clip string, answer string")
    got = cycles.fields(answer)
    expected = spark.createDataFrame([("c", "cycle_count", 1.0), ("c", "average_cycle_duration_seconds", 10.001), ("d", "cycle_count", 1.0)], "clip string, field string, value double")
    assert {(r.clip, r.field): r.passed for r in cycles.score(expected, got).collect()} == {("c", "cycle_count"): True, ("c", "average_cycle_duration_seconds"): True, ("d", "cycle_count"): False}


def test_fold_recovers_from_a_missed_phase():
    events = [("digging", 0, 1, 1), ("hauling", 2, 3, 1), ("digging", 6, 7, 1), ("hauling", 8, 9, 1), ("dumping", 10, 11, 1), ("swinging", 12, 13, 1), ("digging", 14, 15, 1)]
    found, stop = search.fold(events, 100.0)
    assert [(f[0], f[2], f[5]) for f in found] == [("digging", 0, True), ("hauling", 2, True), ("digging", 6, False), ("hauling", 8, False), ("dumping", 10, False), ("swinging", 12, False), ("digging", 14, False)]
    assert stop == "hauling"
    assert search.fold([], 1.0) == ([], "digging")
