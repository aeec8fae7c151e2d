"""Two-pass phase detection of one series: weighted cues in gated windows, then exact starts.

The search is a fold (each step begins where the last window ended), so a series is one group
of a grouped Pandas function; its signals come from window expressions (features.py). All times
are seconds; masks are arrays over the samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .cycles import PHASES
from .order_stats import Ranked
from .patterns import peaks, widths

# fixed values: window widths and limits in seconds, thresholds, and the weight of each cue
MIN_HALF, MAX_HALF, SLOPE_SIDE, LOOKAHEAD, TAKEOFF, NEAR = 0.75, 1.2, 1.0, 1.0, 1.5, 5.0
SIDE, FLAT, STEEP, SIGMA, RETRIES = 2.0, 0.08, 0.25, 3.0, 30
WEIGHTS = {
    "digging": {"speed_min": 3, "height_drop_end": 3, "dx_crossing": 2, "dh_back_to_0": 1, "x_drop_end": 3},
    "hauling": {"height_takeoff": 3, "truck_x_takeoff": 3},
    "dumping": {"height_second_hump": 2, "dh_near_0": 1, "dx_positive": 1, "overlapping": 1},
    "swinging": {"x_takeoff": 3, "height_peak": 1, "dh_positive_falling": 1},
}
RATE = {"digging": ("speed_2d", -1), "hauling": ("dh_dt", 1), "dumping": ("aspect_ratio_dt", -1), "swinging": ("pile_truck_pos_dt", 0)}  # 0: either way
SIGNALS = ("height", "dh_dt", "dx_dt", "speed_2d", "over", "aspect_ratio", "aspect_ratio_dt", "pile_truck_pos", "pile_truck_pos_dt", "cabin_pile_truck_pos")


@dataclass
class Event:
    a: float
    b: float
    centre: float
    mode: str = "centre"
    key: str = ""
    before_end: bool = False


@dataclass
class Window:
    a: float
    b: float
    votes: float = 0.0
    weak: bool = False
    core: tuple[float, float] | None = None

    @property
    def heart(self) -> tuple[float, float]:
        """Where most cues agree; the window itself if no vote made it."""
        return self.core or (self.a, self.b)


def islands(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def quantile(v: np.ndarray, share: float) -> float:
    """The quantile of what is not NaN, between its two neighbours with one rounding of the sum, as quantile_cont has it."""
    v = np.sort(v[~np.isnan(v)])
    at = (len(v) - 1) * share
    k = int(at)
    return math.fma(float(v[k]), 1 - (at - k), float(v[min(k + 1, len(v) - 1)]) * (at - k))


@dataclass
class Series:
    """One series' signals and what is read off them once."""

    t: np.ndarray
    v: dict[str, np.ndarray]
    cache: dict = field(default_factory=dict)

    def once(self, *key, make: Callable):
        if key not in self.cache:
            self.cache[key] = make()
        return self.cache[key]

    def spread(self, name: str) -> float:
        x = self.v[name][np.isfinite(self.v[name])]
        s = float(np.percentile(x, 95) - np.percentile(x, 5)) if len(x) else 0.0
        return s if s > 0 else 1.0

    def noise(self, name: str) -> float:
        def make():
            d = np.diff(self.v[name][np.isfinite(self.v[name])])
            return 1.4826 * float(np.median(np.abs(d - np.median(d)))) / np.sqrt(2) if len(d) > 1 else np.nan

        return self.once("noise", name, make=make)

    def sides(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Trend over SIDE seconds before and after each sample, in spreads."""

        def make():
            v, n = self.v[name], max(1, round(SIDE / float(np.median(np.diff(self.t)))))
            slope = np.full(len(v), np.nan)
            if len(v) > n:
                k = np.arange(n + 1) - n / 2
                slope[n:] = np.lib.stride_tricks.sliding_window_view(v, n + 1) @ k / (k @ k) * SIDE / float(np.median(np.diff(self.t))) / self.spread(name)
            return slope, np.concatenate([slope[n:], np.full(min(n, len(v)), np.nan)])[: len(v)]

        return self.once("sides", name, make=make)

    def drops(self, name: str, least: float, seconds: float) -> list[tuple[int, int, int]]:
        """(onset, steepest, bottom) of big falls."""

        def make():
            v, s = self.v[name], self.spread(name)
            g = np.gradient(v, self.t)
            out = []
            for a, b in islands(np.nan_to_num(g) < -0.1 * s):
                inner = [k for k in range(max(a, 1), min(b, len(g) - 2) + 1) if g[k] <= g[k - 1] and g[k] <= g[k + 1]]
                if inner and v[a] - v[b] >= least * s and self.t[b] - self.t[a] <= seconds:
                    out.append((a, inner[0], b))
            return out

        return self.once("drops", name, least, seconds, make=make)

    def bumps(self, name: str, sign: int, least: float) -> list[tuple[int, int, int]]:
        """(start, apex, end) of peaks (sign 1) or dips (-1)."""

        def make():
            x = sign * np.nan_to_num(self.v[name])
            out = []
            for top, _, _, _ in peaks(x, least * self.spread(name)):
                a = b = top
                while a > 0 and x[a - 1] < x[a]:
                    a -= 1
                while b < len(x) - 1 and x[b + 1] < x[b]:
                    b += 1
                out.append((a, top, b))
            return out

        return self.once("bumps", name, sign, least, make=make)

    def knees(self, name: str, sign: int, flat: float = FLAT, steep: float = STEEP, within: np.ndarray | None = None) -> list[tuple[int, int]]:
        before, after = self.sides(name)
        with np.errstate(invalid="ignore"):
            hit = (np.abs(before) < flat) & (after * sign >= steep)
        return islands(hit if within is None else hit & within)

    def peaks(self, name: str, least: float) -> list[tuple[int, float, int, int]]:
        """Tops of a prominence of `least` spreads."""
        return self.once("peaks", name, least, make=lambda: peaks(np.nan_to_num(self.v[name]), least * self.spread(name)))

    def place(self, time: float) -> int:
        """The first sample at or after a time."""
        return int(np.searchsorted(self.t, time))

    def noise_of(self, v: np.ndarray) -> float:
        v = v[np.isfinite(v)]
        d = np.diff(v)
        return 1.4826 * float(np.median(np.abs(d - np.median(d)))) / np.sqrt(2) if len(v) >= 3 else np.nan

    def first(self, mask: np.ndarray, start: float) -> int | None:
        k = np.flatnonzero(mask & (self.t >= start - 1e-9))
        return int(k[0]) if len(k) else None

    def descent(self, name: str, k: int, tolerance: float = 0.0) -> int:
        """Lowest sample reached while falling from k."""
        v, low = self.v[name], k
        while k + 1 < len(v) and v[k + 1] <= v[k] + tolerance:
            k += 1
            low = k if v[k] < v[low] else low
        return low


class Cues:
    """The cue finders: each gives the first event from an anchor on, or None.

    `dig` is this cycle's digging window, `gate` the phase's gate over the samples."""

    def __init__(self, s: Series):
        self.s, self.t = s, s.t

    def _event(self, a: int, b: int, centre: int, key: str, mode: str = "centre", **more) -> Event:
        return Event(self.t[a], self.t[b], self.t[centre], mode, key, **more)

    def _height_drop(self, anchor: float):
        return next((d for d in self.s.drops("height", 0.5, 6.0) if self.t[d[2]] >= anchor), None)

    def _falls_from(self, anchor: float) -> float | None:
        """When the next big height drop sets on."""
        return next((self.t[d[0]] for d in self.s.drops("height", 0.5, 6.0) if self.t[d[0]] >= anchor), None)

    def speed_min(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        """Where speed stops falling after its next hump."""
        for _, apex, _ in self.s.bumps("speed_2d", 1, 0.5):
            if self.t[apex] >= anchor:
                low = self.s.descent("speed_2d", apex)
                return self._event(apex, low, low, "speed_2d")
        return None

    def height_drop_end(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        d = self._height_drop(anchor)
        return self._event(d[0], d[2], d[2], "height") if d else None

    def dh_back_to_0(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        d = self._height_drop(anchor)
        k = self.s.first(self.s.v["dh_dt"] >= -self.s.noise("dh_dt"), self.t[d[1]]) if d else None
        return None if k is None else self._event(d[1], k, k, "dh_dt")

    def dx_crossing(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        """From where the rate toward the truck is back at 0 after a dip, over the next little peak, to the drop's end."""
        name = "pile_truck_pos_dt"
        v = self.s.v[name]
        dip = next((d for d in self.s.bumps(name, -1, 0.5) if self.t[d[1]] >= anchor), None)
        up = self.s.first(v >= -self.s.noise(name), self.t[dip[1]]) if dip else None
        if up is None:
            return None
        top = up
        while top + 1 < len(v) and v[top + 1] >= v[top]:
            top += 1
        return self._event(up, self.s.descent(name, top), up, name, "span")

    def x_drop_end(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        """Arrival at the pile: within a tenth of the drop of the lowest place before it rises again, noise let pass."""
        name = "pile_truck_pos"
        v = self.s.v[name]
        d = next((d for d in self.s.drops(name, 0.5, 6.0) if self.t[d[2]] >= anchor), None)
        if d is None:
            return None
        low = self.s.descent(name, d[2], self.s.noise(name))
        near = np.flatnonzero(v[d[0] : low + 1] <= v[low] + 0.1 * (v[d[0]] - v[low]))
        a = d[0] + int(near[0]) if len(near) else low
        return Event(self.t[a], min(self.t[a] + 2 * MAX_HALF, self.t[-1]), self.t[a], "fixed", name)

    def height_takeoff(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        """After the dig, the first rise above its tallest height that goes on rising."""
        if dig is None:
            return None
        v, (_, after) = self.s.v["height"], self.s.sides("height")
        inside = (self.t >= dig.heart[0]) & (self.t <= dig.heart[1])
        level = np.nanmax(v[inside]) if np.isfinite(v[inside]).any() else np.inf
        k = self.s.first((v > level) & (np.nan_to_num(after) >= FLAT), dig.heart[1])
        return None if k is None else Event(self.t[k], self.t[k] + TAKEOFF, self.t[k], "fixed", "height")

    def truck_x_takeoff(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        """The first sharp bend toward the truck, before it, that passes the gate; as wide as the looser bend around it."""
        name = "pile_truck_pos"
        before_truck = self.s.v[name] < 1
        sharp = self.s.knees(name, 1, within=before_truck)
        loose = self.s.knees(name, 1, 2 * FLAT, STEEP / 2, before_truck)
        for p, q in sharp:
            if self.t[q] < anchor:
                continue
            a, b = max(self.t[p], anchor), self.t[q]
            if gate[self.s.place(a) : self.s.place(b + LOOKAHEAD) + 1].any():
                bend = next(((self.t[c], self.t[d]) for c, d in loose if self.t[c] <= b and self.t[d] >= a), (a, b))
                a, b = max(min(a, bend[0]), anchor), max(b, bend[1])
                return Event(a, b, (a + b) / 2, "span", name)
        return None

    def dump_candidates(self, anchor: float) -> list[Event]:
        """Every tip: a drop of the aspect ratio by 30 % of its spread, centred where it is steepest."""
        return [self._event(d[0], d[2], d[1], "aspect_ratio") for d in self.s.drops("aspect_ratio", 0.3, 2.5) if self.t[d[1]] >= anchor]

    def height_second_hump(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        """The climb into the last top before the next big drop: from a tenth to nine tenths of its rise."""
        v = self.s.v["height"]
        end = self._falls_from(anchor)
        tops = [p[0] for p in self.s.peaks("height", 0.03)]
        before = [] if end is None else [p for p in tops if anchor <= self.t[p] <= end + 1e-9]
        if not before:
            return None
        top = before[-1]
        lo = max(max((p for p in tops if p < top), default=0), self.s.place(anchor))
        base = float(np.nanmin(v[lo : top + 1]))
        rise = v[top] - base
        low = np.flatnonzero(~(v[lo : top + 1] > base + 0.1 * rise))
        q = lo + int(low[-1]) if len(low) else lo
        half = np.flatnonzero(v[q : top + 1] >= base + 0.5 * rise)
        m = q + int(half[0]) if len(half) else q
        high = np.flatnonzero(v[m : top + 1] >= base + 0.9 * rise)
        return self._event(q, m + int(high[0]) if len(high) else top, q, "height", before_end=True)

    def x_takeoff(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        """The first bend away from rest along the line, either way."""
        spans = sorted(self.s.knees("pile_truck_pos", 1) + self.s.knees("pile_truck_pos", -1))
        return self._clipped(spans, anchor, "pile_truck_pos")

    def _clipped(self, spans: list[tuple[int, int]], anchor: float, key: str) -> Event | None:
        hit = next(((a, b) for a, b in spans if self.t[b] >= anchor), None)
        if hit is None:
            return None
        a, b = max(self.t[hit[0]], anchor), self.t[hit[1]]
        return Event(a, b, (a + b) / 2, key=key)

    def height_peak(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        """The climb into the last wide top before the next big drop, where it is within 20 % of the top."""
        v = self.s.v["height"]
        end = self._falls_from(anchor)
        found, two_seconds = self.s.peaks("height", 0.15), 2.0 / float(np.median(np.diff(self.t)))
        wide = [p for p, w in zip(found, widths(np.nan_to_num(v), found), strict=True) if w[0] >= two_seconds]
        before = [] if end is None else [p for p in wide if anchor <= self.t[p[0]] <= end + 1e-9]
        if not before:
            return None
        top, _, left, _ = before[-1]
        lo = max(left, self.s.place(anchor))
        base = float(np.nanmin(v[lo : top + 1]))
        near = np.flatnonzero(v[lo : top + 1] >= base + 0.8 * (v[top] - base))
        k = lo + int(near[0]) if len(near) else top
        return self._event(k, top, k, "height")

    def dh_positive_falling(self, anchor: float, dig: Window | None, gate: np.ndarray) -> Event | None:
        v = self.s.v["dh_dt"]
        return self._clipped(islands(np.nan_to_num((v > self.s.noise("dh_dt")) & (np.gradient(v, self.t) < 0)).astype(bool)), anchor, "dh_dt")

    def checks(self) -> dict[str, np.ndarray]:
        v = self.s.v
        return {"dh_near_0": np.abs(v["dh_dt"]) <= 3 * self.s.noise("dh_dt"), "dx_positive": v["pile_truck_pos_dt"] > 0, "overlapping": v["over"] > 0}

    def half_width(self, e: Event) -> float:
        """Timing error: noise over the change of slope at the centre, within limits."""
        v, near = self.s.v[e.key], lambda lo, hi: (self.t >= lo - 1e-9) & (self.t <= hi + 1e-9) & np.isfinite(self.s.v[e.key])
        slopes = []
        for m in (near(e.centre - SLOPE_SIDE, e.centre), near(e.centre, e.centre + SLOPE_SIDE)):
            slopes.append(np.polyfit(self.t[m], v[m], 1)[0] if m.sum() >= 3 else np.nan)
        turn = abs(slopes[1] - slopes[0])
        raw = self.s.noise(e.key) / turn if np.isfinite(turn) and turn > 0 else np.inf
        return float(min(max(raw, MIN_HALF), MAX_HALF))

    def widen(self, e: Event, anchor: float) -> Window:
        if e.mode == "fixed":
            lo, hi = e.a, e.b
        elif e.mode == "span":
            lo, hi = e.a - MIN_HALF, e.b + MIN_HALF
        else:
            h = self.half_width(e)
            lo, hi = e.centre - h, e.centre + h
            if e.before_end:
                hi = min(hi, e.b - 1e-3)
        lo = max(lo, anchor)
        return Window(lo, max(hi, lo))


def voted(t: np.ndarray, windows: list[tuple[Window, float]], total: float, inside: Window | None = None) -> tuple[int, int, float, bool] | None:
    """First run of samples with more than half the weight, else the run with most (weak)."""
    count = np.zeros(len(t))
    for w, weight in windows:
        count += weight * ((t >= w.a - 1e-9) & (t <= w.b + 1e-9))
    if inside is not None:
        count[(t < inside.a - 1e-9) | (t > inside.b + 1e-9)] = 0
    if not count.any():
        return None
    strong = islands(2 * count > total)
    a, b = strong[0] if strong else islands(count == count.max())[0]
    return a, b, float(count[a : b + 1].max()), not strong


class Search:
    """The fold over one series."""

    def __init__(self, s: Series):
        self.s, self.t, self.cues = s, s.t, Cues(s)

    def level(self, anchor: float, dig: Window | None) -> np.ndarray:
        """This cycle's dig height: the median in its window, or of what was seen since the anchor."""
        v = self.s.v["height"]
        if dig is not None:
            inside = v[(self.t >= dig.heart[0]) & (self.t <= dig.heart[1])]
            return np.full(len(v), float(np.nanmedian(inside)) if np.isfinite(inside).any() else np.nan)
        k, at = self.s.place(anchor), np.arange(len(v))
        return self.s.once("ranked", make=lambda: Ranked(v)).median(np.minimum(k, at), at)

    def gate(self, phase: str, anchor: float, dig: Window | None) -> np.ndarray:
        v = self.s.v
        with np.errstate(invalid="ignore"):
            if phase == "digging":
                return (v["over"] <= 0) & (v["pile_truck_pos"] < 1)
            if phase == "hauling":
                return (v["height"] > self.level(anchor, dig)) & (v["over"] <= 0)
            if phase == "dumping":
                return (v["pile_truck_pos"] - v["cabin_pile_truck_pos"] > 0) & (v["height"] > self.level(anchor, dig))
        return np.ones(len(self.t), bool)

    def passes(self, e: Event, gate: np.ndarray) -> bool:
        return bool(gate[self.s.place(e.a) : self.s.place(e.b + LOOKAHEAD) + 1].any())

    def event(self, name: str, start: float, gate: np.ndarray, dig: Window | None) -> Event | None:
        """The cue's first event that passes the gate; after so many that don't, the next as it is."""
        e = getattr(self.cues, name)(start, dig, gate)
        for _ in range(RETRIES):
            if e is None or self.passes(e, gate):
                break
            e = getattr(self.cues, name)(e.b + 1e-3, dig, gate)
        return e

    def step(self, phase: str, anchor: float, dig: Window | None) -> Window | None:
        gate = self.gate(phase, anchor, dig)
        k = self.s.first(gate, anchor)
        if k is None:
            return None
        start = max(anchor, self.t[k] - LOOKAHEAD)
        if phase == "dumping":
            return self.dump(start, gate, dig)
        weights = WEIGHTS[phase]
        found = {n: e for n in weights if (e := self.event(n, start, gate, dig)) is not None}
        windows = {n: self.cues.widen(e, start) for n, e in found.items()}
        required = windows.get("height_takeoff") if phase == "hauling" else None
        if phase == "hauling":
            if required is None:
                return None
            windows = {n: w for n, w in windows.items() if not (w.a > required.b + NEAR or w.b < required.a - NEAR)}
        total = float(sum(weights[n] for n in windows) if phase == "hauling" else sum(weights.values()))
        got = voted(self.t, [(w, weights[n]) for n, w in windows.items()], total, required)
        if got is None:
            return None
        a, b, votes, _ = got
        mid = (self.t[a] + self.t[b]) / 2
        agree = [w for w in windows.values() if w.a <= self.t[b] and w.b >= self.t[a]]
        lo, hi = max(min((w.a for w in agree), default=self.t[a]), mid - MAX_HALF, start), min(max((w.b for w in agree), default=self.t[b]), mid + MAX_HALF)
        return Window(lo, max(hi, lo), votes, votes <= total / 2, (float(self.t[a]), float(self.t[b])))

    def dump(self, start: float, gate: np.ndarray, dig: Window | None) -> Window | None:
        """Of the tips inside the first visit to the truck that ends after the start, the one with most support; of equals the earlier."""
        visit = next(((self.t[a], self.t[b]) for a, b in islands(self.s.v["over"] > 0) if self.t[b] > start), None)
        weights, best = WEIGHTS["dumping"], None
        hump = self.event("height_second_hump", start, gate, dig)
        for e in self.cues.dump_candidates(start):
            if not self.passes(e, gate) or visit is not None and not visit[0] - 1e-9 <= e.centre <= visit[1] + 1e-9:
                continue
            w = self.cues.widen(e, start)
            votes = 0.0
            if hump is not None:
                h = self.cues.widen(hump, start)
                votes += weights["height_second_hump"] * (h.a <= w.b and h.b >= w.a)
            for n, mask in self.cues.checks().items():
                votes += weights[n] * any(self.t[q] >= w.a and self.t[p] <= w.b for p, q in islands(np.nan_to_num(mask).astype(bool)))
            if best is None or votes > best.votes:
                best = Window(w.a, w.b, votes, votes <= sum(weights.values()) / 2, (w.a, w.b))
        return best

    def visits(self) -> list[tuple[float, float]]:
        """Stretches over the truck at least half as long as the longest."""
        spans = [(self.t[a], self.t[b]) for a, b in islands(self.s.v["over"] > 0)]
        longest = max((b - a for a, b in spans), default=0.0)
        return [x for x in spans if x[1] - x[0] >= 0.5 * longest]

    def dig(self, anchor: float, reach: int | None = 2, settle: bool = True) -> Window | None:
        """A digging window in the next open stretches: cues first, else where the bucket settles.

        The search for a strong dig looks at all stretches (reach None) and at cues alone."""
        edges = [(self.t[0], self.t[0]), *self.visits(), (self.t[-1], self.t[-1])]
        stretches = [(a[1], b[0]) for a, b in zip(edges, edges[1:], strict=False) if b[0] > a[1]]
        for n, (lo, hi) in [x for x in enumerate(stretches) if x[1][1] > anchor + 1e-6][:reach]:
            last = n == len(stretches) - 1
            start, top = max(lo, anchor), self.climb(lo, hi, last)
            if top <= start:
                continue
            w = self.step("digging", start, None)
            if w is not None and start - 1e-9 <= sum(w.heart) / 2 <= top:
                return Window(w.a, min(w.b, top), w.votes, w.weak, w.core)
            k = self.settled(start, top, self.levels(lo, hi, last)) if settle else None
            if k is not None:
                a, b = max(start, self.t[k] - MIN_HALF), min(top, self.t[k] + MIN_HALF)
                return Window(a, b, 0.0, True, (a, b))
        return None

    def levels(self, lo: float, hi: float, last: bool) -> tuple[float, float]:
        """A stretch's pile level, and its height on arriving over the truck; the last one has no truck behind it."""
        v = self.s.v["height"]
        inside = v[(self.t >= lo) & (self.t <= hi)]
        if not np.isfinite(inside).any():
            return np.nan, np.nan
        return quantile(inside, 0.05), quantile(inside, 0.95) if last else float(v[max(self.s.place(hi) - 1, 0)])

    def climb(self, lo: float, hi: float, last: bool) -> float:
        """When the lift to the truck leaves the pile: a tenth up, before the last rise through halfway; else the stretch's end."""
        pile, above = self.levels(lo, hi, last)
        if last or not above > pile:
            return hi
        v = self.s.v["height"]
        k = np.flatnonzero((self.t >= lo) & (self.t <= hi))
        mid = (pile + above) / 2
        up = k[1:][(v[k[1:] - 1] < mid) & (v[k[1:]] >= mid)]
        if not len(up):
            return hi
        back = np.flatnonzero(~(v[k[0] : up[-1] + 1] > pile + 0.1 * (above - pile)))
        return float(self.t[k[0] + back[-1]] if len(back) else self.t[k[0]])

    def settled(self, start: float, top: float, levels: tuple[float, float]) -> int | None:
        """First sample from start to top that lies in the pile: low, on its side, off the truck and calm.

        Low is a quarter of the way from the stretch's pile level to its height on arrival."""
        v, s = self.s.v, self.s
        calm = max(SIGMA * s.noise("speed_2d"), 0.02 * float(np.nanmax(v["speed_2d"]) - np.nanmin(v["speed_2d"])))
        with np.errstate(invalid="ignore"):
            ok = (self.t >= start) & (self.t <= top) & (v["height"] <= levels[0] + 0.25 * (levels[1] - levels[0])) & (v["pile_truck_pos"] < 1) & (v["over"] <= 0) & (v["speed_2d"] <= calm)
        k = np.flatnonzero(ok)
        return int(k[0]) if len(k) else None

    def run(self) -> tuple[list[tuple[str, Window, bool]], list[tuple], tuple | None]:
        """(phase, window, abandoned) in order; gaps (phase, from, to, why); and (phase, from, why) where the search stopped.

        Each phase is searched for behind the window of the one before, round and round. A strong
        dig is one that the cues find. A phase that is missed, or begins after such a dig, abandons
        its cycle for it; a weak window counts only if such a dig follows. No stop: the series was
        read to its end."""
        found: list[list] = []
        gaps: list[tuple] = []
        at, nth, dig, opened = float(self.t[0]), 0, None, 0
        stop = None
        while at < self.t[-1]:
            phase = PHASES[nth % len(PHASES)]
            strong = lambda: self.dig(at, None, settle=False)  # noqa: B023, E731
            if phase == PHASES[0]:
                w = self.dig(at)
                if w is None:
                    w = strong()
                    if w is None:
                        stop = (phase, at, NO_DIG)
                        break
                    gaps.append((phase, at, w.a, NO_NEAR_DIG))
                dig, opened = w, len(found)
            else:
                w, again = self.step(phase, at, dig), strong()
                late = w is not None and again is not None and again.b <= w.a + 1e-9
                if w is not None and not late and w.weak and again is None:
                    stop = (phase, at, WEAK.format(w.a))
                    break
                if w is None or late:
                    if again is None:
                        stop = (phase, at, NO_WINDOW)
                        break
                    gaps.append((phase, at, again.a, (LATE.format(w.a) if late else NO_WINDOW) + ABANDONED))
                    for f in found[opened:]:
                        f[2] = True
                    w, phase, nth, dig, opened = again, PHASES[0], 0, again, len(found)
            found.append([phase, w, False])
            if w.b <= at + 1e-6:
                stop = (phase, at, STUCK)
                break
            at, nth = w.b, nth + 1
        return [tuple(f) for f in found], gaps, stop

    def start(self, phase: str, w: Window) -> tuple[float, bool]:
        """When the phase began inside its window; the middle (a fallback) if nothing moved faster than noise.

        A dig begins where speed is least; the others where the rate, walked back from its fastest,
        was last within three times its own noise."""
        name, sign = RATE[phase]
        v = self.s.v[name]
        signed = np.abs(v) if sign == 0 else sign * v
        k = np.flatnonzero((self.t >= w.a) & (self.t <= w.b) & np.isfinite(v))
        middle = (w.a + w.b) / 2, True
        if phase == PHASES[0]:
            return (float(self.t[k[np.argmax(signed[k])]]), False) if len(k) else middle
        if len(k) < 5:  # too few samples to tell movement from noise
            return middle
        band = SIGMA * self.s.noise_of(signed[k])
        i = int(k[np.argmax(signed[k])])
        if not np.isfinite(band) or signed[i] <= band:
            return middle
        while i > k[0] and np.isfinite(signed[i - 1]) and signed[i - 1] > band:
            i -= 1
        return float(self.t[i]), False


# fixed values: why a search stopped, and why a cycle was given up
NO_DIG = "no dig found after this point: the clip may end before another cycle starts"
NO_NEAR_DIG = "no dig in the next two open stretches; restarted at the next strong dig"
NO_WINDOW = "no window found"
STUCK = "did not move forward"
WEAK = "only a low-agreement window ({:.1f} s) and no dig after it: the clip may end before this stage"
LATE = "its window ({:.1f} s) came after a strong dig"
ABANDONED = "; cycle abandoned, restarted at the dig"

STARTS = "series string, nth int, phase string, time double, win_a double, win_b double, weak boolean, fallback boolean, abandoned boolean, stop string, stop_from double, why string"
GAPS = "series string, nth int, phase string, from double, to double, why string"


def find(frame: pd.DataFrame) -> tuple[list[tuple], list[tuple], tuple | None]:
    """(phase, time, window a, b, weak, fallback, abandoned) of one series, its gaps, and where and why it stopped."""
    frame = frame.sort_values("t")
    s = Series(frame["t"].to_numpy(float), {c: frame[c].to_numpy(float) for c in SIGNALS})
    s.v["over"] = np.nan_to_num(s.v["over"])
    with np.errstate(invalid="ignore"):
        search = Search(s)
        found, gaps, stop = search.run()
        return [(p, *((x := search.start(p, w))[:1]), w.a, w.b, bool(w.weak), x[1], gone) for p, w, gone in found], gaps, stop


def _searched(pdf: pd.DataFrame) -> tuple[list[tuple], list[tuple], tuple | None]:
    return find(pdf) if len(pdf) > 4 else ([], [], (PHASES[0], None, NO_DIG))


def phase_starts(signals: DataFrame) -> DataFrame:
    """signals (series, t and SIGNALS) -> phase starts, and one closing row per series: its stop, NULL if it was read to the end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["series"].iloc[0]
        found, _, stop = _searched(pdf)
        rows = [(name, n, *f, None, None, None) for n, f in enumerate(found)] + [(name, len(found), *[None] * 7, *(stop or (None, None, None)))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STARTS.split(", ")])

    return signals.select("series", "t", *SIGNALS).groupBy("series").applyInPandas(run, STARTS)


def phase_gaps(signals: DataFrame) -> DataFrame:
    """The cycles that the search gave up: the phase it looked for, from when, the dig it went on from, and why."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["series"].iloc[0], n, *g) for n, g in enumerate(_searched(pdf)[1])], columns=[c.split()[0] for c in GAPS.split(", ")])

    return signals.select("series", "t", *SIGNALS).groupBy("series").applyInPandas(run, GAPS.replace("from double", "`from` double").replace("to double", "`to` double"))


EVENTS = "series string, cue string, nth int, a double, b double, centre double"


def cue_events(signals: DataFrame) -> DataFrame:
    """What each cue finds first in a series, with every gate open and no dig yet; of the tips every candidate.

    signals (series, t and SIGNALS). A cue that finds nothing, or needs a dig, has no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = pdf.sort_values("t")
        name, s = frame["series"].iloc[0], Series(frame["t"].to_numpy(float), {c: frame[c].to_numpy(float) for c in SIGNALS})
        cues, rows = Cues(s), []
        with np.errstate(invalid="ignore"):
            for cue in (c for weights in WEIGHTS.values() for c in weights if hasattr(cues, c)):
                e = getattr(cues, cue)(s.t[0], None, np.ones(len(s.t), bool)) if len(s.t) > 4 else None
                rows += [(name, cue, 0, e.a, e.b, e.centre)] if e is not None else []
            rows += [(name, "tip", n, e.a, e.b, e.centre) for n, e in enumerate(cues.dump_candidates(s.t[0]) if len(s.t) > 4 else [])]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return signals.select("series", "t", *SIGNALS).groupBy("series").applyInPandas(run, EVENTS)


def _each(signals: DataFrame, schema: str, rows: Callable[[Series], list[tuple]]) -> DataFrame:
    """`rows` of every series with more than four samples, its name in front."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = pdf.sort_values("t")
        s = Series(frame["t"].to_numpy(float), {c: frame[c].to_numpy(float) for c in SIGNALS})
        with np.errstate(invalid="ignore"):
            found = [(frame["series"].iloc[0], *r) for r in rows(s)] if len(s.t) > 4 else []
        return pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    return signals.select("series", "t", *SIGNALS).groupBy("series").applyInPandas(run, schema)


def open_readings(signals: DataFrame) -> DataFrame:
    """Of every open stretch: its pile level, the height on arrival, when the lift begins, and when the bucket settled before it."""

    def rows(s: Series) -> list[tuple]:
        search = Search(s)
        edges = [(s.t[0], s.t[0]), *search.visits(), (s.t[-1], s.t[-1])]
        stretches = [(a[1], b[0]) for a, b in zip(edges, edges[1:], strict=False) if b[0] > a[1]]
        out = []
        for n, (lo, hi) in enumerate(stretches):
            last = n == len(stretches) - 1
            levels, top = search.levels(lo, hi, last), search.climb(lo, hi, last)
            k = search.settled(lo, top, levels)
            out.append((n, lo, hi, *levels, top, None if k is None else s.t[k]))
        return out

    return _each(signals, "series string, nth int, a double, b double, pile double, arrival double, climb double, settled double", rows)


def gates(signals: DataFrame, first: float, last: float) -> DataFrame:
    """Every sample with the gates of digging, hauling and dumping, the dig window reaching from `first` to `last` seconds."""

    def rows(s: Series) -> list[tuple]:
        search, dig = Search(s), Window(s.t[0] + first, s.t[0] + last)
        open_ = [search.gate(p, s.t[0], dig) for p in PHASES[:3]]
        return [(t, *(bool(g[k]) for g in open_)) for k, t in enumerate(s.t.tolist())]

    return _each(signals, "series string, t double, digging boolean, hauling boolean, dumping boolean", rows)


def half_widths(signals: DataFrame, key: str) -> DataFrame:
    """The timing error of an event of the signal `key` at each sample."""

    def rows(s: Series) -> list[tuple]:
        cues = Cues(s)
        return [(t, cues.half_width(Event(t, t, t, key=key))) for t in s.t.tolist()]

    return _each(signals, "series string, t double, half double", rows)


def window_starts(signals: DataFrame, length: float) -> DataFrame:
    """When each phase would begin inside each window of `length` seconds, one behind the other."""

    def rows(s: Series) -> list[tuple]:
        search, out = Search(s), []
        for a in np.arange(s.t[0], s.t[-1], length).tolist():
            for phase in PHASES:
                time, fallback = search.start(phase, Window(a, a + length))
                out.append((phase, a, time, bool(fallback)))
        return out

    return _each(signals, "series string, phase string, a double, time double, fallback boolean", rows)
