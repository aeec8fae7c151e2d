"""The two-pass search on made-up work cycles with known starts."""

import numpy as np
import pandas as pd
import pytest

from cadence.operators import features, phases
from cadence.operators.cycles import PHASES

PERIOD = 18.0
#: seconds into a cycle at which each phase begins
TRUE = dict(zip(PHASES, (1.0, 5.0, 11.0, 13.0), strict=True))


def clip(n=3, dt=0.1, noise=0.002):
    rng = np.random.default_rng(7)
    t = np.arange(0, n * PERIOD + 6, dt)
    u = t % PERIOD
    line = lambda *knots: np.interp(u, [k[0] for k in knots], [k[1] for k in knots]) + rng.normal(0, noise, len(t))
    # the bucket rests for a moment on the pile, then works its way through it
    height = line((0, 0.151), (0.8, 0), (1.2, 0), (3, -0.09), (5, 0), (9, 1), (13.5, 1), (18, 0.151))
    pos = line((0, 0.138), (0.8, 0), (1.2, 0), (5, 0.1), (5.5, 0.1), (10, 1), (13, 1), (18, 0.138))
    aspect = line((0, 1.5), (11, 1.5), (12, 0.8), (14, 0.8), (16, 1.5), (18, 1.5))
    g = lambda x: np.gradient(np.convolve(np.pad(x, 4, mode="edge"), np.ones(9) / 9, "valid"), dt)
    dh, dx = g(height), g(pos)
    return pd.DataFrame(
        {
            "series": "s", "t": t, "height": height, "dh_dt": dh, "dx_dt": dx, "speed_2d": np.hypot(dx, dh), "over": ((u > 9.5) & (u < 13.8)).astype(float),
            "aspect_ratio": aspect, "aspect_ratio_dt": g(aspect), "pile_truck_pos": pos, "pile_truck_pos_dt": dx, "cabin_pile_truck_pos": 0.5 * pos + 0.1,
        }
    )


def test_starts_are_found_in_order():
    found, gaps, stop = phases.find(clip())
    # the clip opens in mid-cycle, without a return swing that its first dig could be read from
    assert [f[0] for f in found][:8] == [*PHASES, *PHASES] and not gaps
    for k, f in enumerate(found[:8]):
        true = TRUE[f[0]] + PERIOD * (1 + k // 4)
        assert abs(f[1] - true) <= 0.6, (f, true)
        assert f[2] - 1e-6 <= f[1] <= f[3] + 1e-6 and not f[4] and not f[6]
    assert all(a[2] <= b[2] for a, b in zip(found, found[1:], strict=False))


def test_gaps_and_stops():
    full = clip(4)
    cut = full[full["t"] < 2 * PERIOD + 15.5]  # nothing after the second swing
    found, gaps, stop = phases.find(cut)
    assert [f[0] for f in found][-1] == "swinging" and stop[0] == "digging" and stop[2] == phases.NO_DIG and not gaps
    flat = full.copy()
    second = (flat["t"] >= PERIOD) & (flat["t"] < 2 * PERIOD)
    flat.loc[second, "aspect_ratio"] = 1.5  # no tip: the cycle is given up for the next dig
    flat.loc[second, "aspect_ratio_dt"] = 0.0
    found, gaps, stop = phases.find(flat)
    assert gaps and gaps[0][0] == "dumping" and gaps[0][3] == phases.NO_WINDOW + phases.ABANDONED
    assert abs(gaps[0][2] - 2 * PERIOD - 1) < 1.5 and [f[0] for f in found[:4]] == ["digging", "hauling", "digging", "hauling"]
    assert [f[6] for f in found[:4]] == [True, True, False, False]


def series_of(t, **signals):
    return phases.Series(t, {c: np.asarray(signals.get(c, np.zeros(len(t))), float) for c in phases.SIGNALS})


@pytest.mark.parametrize("way", [1, -1])
def test_a_swing_may_begin_either_way(way):
    t = np.arange(100) * 0.1
    rng = np.random.default_rng(1)
    rate = rng.normal(0, 0.001, 100)
    rate[40:60] += way * np.sin(np.linspace(0, np.pi, 20))
    search = phases.Search(series_of(t, pile_truck_pos_dt=rate))
    at, fallback = search.start("swinging", phases.Window(3.0, 7.0))
    assert not fallback and abs(at - 4.1) <= 0.1
    assert phases.Search(series_of(t, pile_truck_pos_dt=rng.normal(0, 0.001, 100))).start("swinging", phases.Window(3.0, 3.3)) == (3.15, True)


def test_the_climb_leaves_the_pile_level():
    t = np.arange(101) * 0.1
    height = np.interp(t, [0, 6, 9, 10], [0, 0, 1, 1])
    height[30] = -2.0  # one deep sample moves neither level nor climb
    search = phases.Search(series_of(t, height=height))
    assert search.levels(0.0, 10.0, False) == (0.0, 1.0) and abs(search.climb(0.0, 10.0, False) - 6.3) < 0.11
    assert search.climb(0.0, 10.0, True) == 10.0
    assert phases.Search(series_of(t)).climb(0.0, 5.0, False) == 5.0  # nothing rises: the stretch's end


def test_tips_count_inside_the_visit_only():
    t = np.arange(300) * 0.1
    over = ((t >= 5) & (t <= 9) | (t >= 20) & (t <= 24)).astype(float)
    aspect = np.interp(t, [0, 9.3, 10.0, 15, 21, 22, 30], [1.5, 1.5, 0.8, 1.5, 1.5, 0.7, 0.7])
    s = series_of(t, over=over, aspect_ratio=aspect, pile_truck_pos=np.ones(300))
    search = phases.Search(s)
    everywhere = np.ones(300, bool)
    assert len(search.cues.dump_candidates(0.0)) == 2
    assert search.dump(0.0, everywhere, None) is None  # the first tip lies just behind the first visit
    w = search.dump(9.5, everywhere, None)
    assert 20 <= (w.a + w.b) / 2 <= 24


def test_the_last_bend_before_the_drop():
    """Places read off straight lines: where a climb is 10, 20 and 90 % done, and where a drop has come home."""
    t = np.arange(0, 40, 0.1)
    height = np.interp(t, [0, 5, 9, 12, 14, 18, 24, 27, 40], [0, 0, 0.8, 0.8, 0.6, 1.0, 1.0, 0, 0])
    pos = np.interp(t, [0, 20, 24, 30, 40], [1.0, 1.0, 0.1, 0.0, 0.0])
    s = series_of(t, height=height, pile_truck_pos=pos)
    cues, gate = phases.Cues(s), np.ones(len(t), bool)
    hump = cues.height_second_hump(0.0, None, gate)
    assert abs(hump.a - 14.4) < 0.21 and abs(hump.b - 17.6) < 0.21 and hump.centre == hump.a
    swing = cues.height_peak(13.0, None, gate)
    assert abs(swing.a - (14 + 4 * 0.8)) < 0.21
    home = cues.x_drop_end(0.0, None, gate)
    assert 23.9 <= home.a <= 24.1 + 0.5 and home.b <= home.a + 2 * phases.MAX_HALF + 1e-9
    assert cues.height_second_hump(28.0, None, gate) is None  # no drop follows


def test_a_clip_without_a_truck_or_motion_stops():
    still = clip()
    for c in phases.SIGNALS:
        still[c] = 0.0
    found, gaps, stop = phases.find(still)
    assert stop[0] == PHASES[1] and not gaps and [f[0] for f in found] == [PHASES[0]] and found[0][4]  # only a weak sign of digging


def test_grouped(spark):
    two = pd.concat([clip(2), clip(2).assign(series="r")])
    rows = phases.phase_starts(spark.createDataFrame(two)).collect()
    by = {s: [(r.phase, round(r.time, 6)) for r in sorted(rows, key=lambda r: r.nth) if r.series == s and r.phase] for s in "rs"}
    assert by["r"] == by["s"] and len(by["s"]) >= 4
    assert sum(r.stop is not None for r in rows) == 2


def test_assembled_features(spark):
    t = np.arange(40) * 0.1
    rows = [("s", i, float(x), 10.0 + i, 50.0, 20.0 + i, 60.0, 0.0, 80.0, 10.0, 100.0) for i, x in enumerate(t)]
    edges = [p + e for p in "bc" for e in features.EDGES]
    boxes = spark.createDataFrame(rows, ["series", "i", "t", *edges])
    scene = spark.createDataFrame([("s", 0.0, 100.0, 10.0, 100.0, 60.0, 140.0, 90.0)], "series string, px double, py double, reach double, tx0 double, ty0 double, tx1 double, ty1 double")
    out = features.assemble(features.smoothed(boxes, ("b", "c"), 1), scene, 4, 0.1).orderBy("i").toPandas()
    assert np.allclose(out["height"], 100 / 10 - 5.5) and np.allclose(out["bucket_x"], (15 + np.arange(40)) / 10)
    assert np.allclose(out["dx_dt"], 1.0) and np.allclose(out["dh_dt"], 0) and np.allclose(out["aspect_ratio"], 1.0)
    assert (out["truck_overlap"] == 0).all() and out["bfound"].all()
    none = features.assemble(features.smoothed(boxes, ("b", "c"), 1), scene.selectExpr("series", "px", "py", "reach", *(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("tx0", "ty0", "tx1", "ty1"))), 4, 0.1)
    assert features.without_line(none).first().reason == "no truck"
    assert features.signals(none, 4, 0.1).count() == 0


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_series_helpers(shift):
    s = phases.Series(np.arange(50) * 0.1, {"v": np.sin(np.arange(50) / 5) + shift})
    top, low = s.bumps("v", 1, 0.3)[0], s.bumps("v", -1, 0.3)[0]
    assert abs(top[1] - 8) <= 1 and abs(low[1] - 24) <= 1
    assert s.descent("v", top[1]) == low[1]
