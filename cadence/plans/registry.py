"""All queries over the driver's tables, and the DuckDB SQL each one must equal.

`events` stands for many measured series (key: event type or user; regular slots), `lineitem`
for masks and boxes, `orders` for detections and track records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions import geometry as geo
from cadence.operators import cycles, intervals, masks, patterns, phases, search, series, tracks
from cadence.sources import records
from cadence.sources.tables import load, regular_grid, strided
from cadence.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def r6(*columns: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in columns]


def as_sql(*columns: str) -> list:
    """Rounded to six places in binary, as the SQL's round does: times a million, to the nearest, and back. `r6` rounds the decimal that a number is written as."""
    return [(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in columns]


def grid(spark: SparkSession, sf_dir: str, seconds: int = 10800, key: str = "event_type") -> DataFrame:
    return regular_grid(load(spark, sf_dir, "events"), key, seconds)


def g(seconds: int = 10800, key: str = "event_type") -> str:
    """The same grid as common table expressions; the last one is g(series, i, v)."""
    return f"""WITH m AS (SELECT CAST({key} AS VARCHAR) AS series, CAST(floor(floor(epoch(ts)) / {seconds}) AS BIGINT) AS slot, round(avg(value), 6) AS v FROM events GROUP BY 1, 2),
f AS (SELECT series, min(slot) AS lo, max(slot) AS hi FROM m GROUP BY 1), s AS (SELECT series, lo, unnest(range(lo, hi + 1)) AS slot FROM f),
g AS (SELECT s.series, s.slot - s.lo AS i, m.v FROM s LEFT JOIN m ON m.series = s.series AND m.slot = s.slot)"""


W = "PARTITION BY series ORDER BY i"
SPREAD = "sp AS (SELECT series, CASE WHEN quantile_cont(v, 0.95) - quantile_cont(v, 0.05) > 0 THEN quantile_cont(v, 0.95) - quantile_cont(v, 0.05) ELSE 1 END AS spread FROM g GROUP BY series)"


def runs_sql(name: str, source: str, condition: str) -> str:
    return f"""{name} AS (SELECT series, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT series, i, row_number() OVER ({W}) - row_number() OVER (PARTITION BY series, coalesce({condition}, false) ORDER BY i) AS grp, coalesce({condition}, false) AS hit FROM {source}) WHERE hit GROUP BY series, grp)"""


# ---- grids, smoothing, rates -------------------------------------------------------------------


@query("ts_grid", f"{g()} SELECT * FROM g")
def ts_grid(spark, d):
    return grid(spark, d)


@query("ts_grid_users", f"{g(86400, 'user_id')} SELECT * FROM g")
def ts_grid_users(spark, d):
    return grid(spark, d, 86400, "user_id")


def _moving(align: str, rows: str) -> None:
    @query(f"moving_average_{align}", f"{g(3600)} SELECT series, i, CASE WHEN count(v) OVER w >= least(3, count(*) OVER w) THEN round(avg(v) OVER w, 9) END AS ma FROM g WINDOW w AS ({W} ROWS BETWEEN {rows})")
    def moving(spark, d):
        return grid(spark, d, 3600).select("series", "i", F.round(series.moving_average("v", 6, align), 9).alias("ma"))


_moving("trailing", "5 PRECEDING AND CURRENT ROW")
_moving("leading", "CURRENT ROW AND 5 FOLLOWING")
_moving("centred", "2 PRECEDING AND 3 FOLLOWING")

FILLED = f"""p AS (SELECT series, i, v, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1, first_value(v IGNORE NULLS) OVER a AS v1 FROM g
WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q AS (SELECT series, i, CASE WHEN i0 = i1 THEN v ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END AS v FROM p)"""


@query("interpolate_gaps", f"{g(3600)}, {FILLED} SELECT series, i, round(v, 6) AS filled FROM q")
def interpolate_gaps(spark, d):
    return grid(spark, d, 3600).select("series", "i", F.round(series.interpolated("v"), 6).alias("filled"))


@query(
    "sg_derivative",
    f"""{g(3600)}, {FILLED}, z AS (SELECT series, i, v AS f, coalesce(v, 0.0) AS v, count(*) OVER (PARTITION BY series) AS n, row_number() OVER ({W}) - 1 AS r FROM q),
k AS (SELECT *, r - 4 AS kh, r - (n - 5) AS kt, regr_slope(v, CAST(i AS DOUBLE)) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS slope FROM z),
e AS (SELECT series, sum(CASE WHEN kh BETWEEN -4 AND 4 THEN kh * v END) / 60.0 AS a1, sum(CASE WHEN kh BETWEEN -4 AND 4 THEN (kh * kh - 20.0 / 3) * v END) / 308.0 AS a2, sum(CASE WHEN kt BETWEEN -4 AND 4 THEN kt * v END) / 60.0 AS b1, sum(CASE WHEN kt BETWEEN -4 AND 4 THEN (kt * kt - 20.0 / 3) * v END) / 308.0 AS b2 FROM k GROUP BY series)
SELECT k.series, k.i, CASE WHEN n > 9 AND f IS NOT NULL THEN round(CASE WHEN r < 4 THEN a1 + 2 * a2 * kh WHEN r > n - 5 THEN b1 + 2 * b2 * kt ELSE slope END, 6) END AS rate FROM k JOIN e USING (series)""",
)
def sg_derivative(spark, d):
    return series.derivative(grid(spark, d, 3600), "v", "rate", 4).select("series", "i", *r6("rate"))


@query("gradient", f"{g()} SELECT series, i, round(CASE WHEN lag(i) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(i) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w + 0 * v - lag(v) OVER w) / 2 END, 9) AS grad FROM g WINDOW w AS ({W})")
def gradient(spark, d):
    return grid(spark, d).select("series", "i", F.round(series.gradient("v"), 9).alias("grad"))


@query("noise_scale", f"{g(3600)}, d AS (SELECT series, v - lag(v) OVER ({W}) AS d FROM g WHERE v IS NOT NULL), k AS (SELECT series, median(d) AS m, count(*) AS n FROM d GROUP BY 1) SELECT d.series, CASE WHEN max(n) >= 3 THEN round(median(abs(d - m)) * 1.4826 / sqrt(2.0), 6) END AS noise FROM d JOIN k USING (series) GROUP BY 1")
def noise_scale(spark, d):
    return series.noise_scale(grid(spark, d, 3600)).select("series", *r6("noise"))


@query("spread", f"{g()}, {SPREAD} SELECT series, round(spread, 6) AS spread FROM sp")
def spread(spark, d):
    return grid(spark, d).groupBy("series").agg(F.round(series.spread(), 6).alias("spread"))


def _trend(n: int) -> str:
    part = lambda rows: f"CASE WHEN count(v) OVER ({W} ROWS BETWEEN {rows}) = {n + 1} THEN regr_slope(v, CAST(i AS DOUBLE)) OVER ({W} ROWS BETWEEN {rows}) * {n} / spread END"
    return f"{SPREAD}, t AS (SELECT series, i, v, spread, {part(f'{n} PRECEDING AND CURRENT ROW')} AS before, {part(f'CURRENT ROW AND {n} FOLLOWING')} AS after FROM g JOIN sp USING (series))"


def trends(spark, d, n: int = 8) -> DataFrame:
    return series.side_changes(series.with_spread(grid(spark, d)), "v", n)


@query("trend_before_after", f"{g()}, {_trend(8)} SELECT series, i, round(before, 6) AS before, round(after, 6) AS after FROM t")
def trend_before_after(spark, d):
    return trends(spark, d).select("series", "i", *r6("before", "after"))


@query("expanding_median", f"{g()} SELECT series, i, round(quantile_cont(v, 0.5) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS past FROM g")
def expanding_median(spark, d):
    return series.expanding_median(grid(spark, d)).select("series", "i", F.round("past", 9).alias("past"))


@query("persistence", f"{g()} SELECT series, i, count(*) OVER w = 4 AND coalesce(min(CAST(coalesce(v > 40, false) AS INT)) OVER w, 0) = 1 AS stays FROM g WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)")
def persistence(spark, d):
    return grid(spark, d).select("series", "i", series.persists(F.col("v") > 40, 3).alias("stays"))


@query("hold_last", f"{g(3600)} SELECT series, i, last_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM g")
def hold_last(spark, d):
    return grid(spark, d, 3600).select("series", "i", series.held("v").alias("held"))


@query("timeline", f"{g(3600)}, x AS (SELECT series, CAST(i - lag(i) OVER ({W}) AS DOUBLE) AS d FROM g WHERE v IS NOT NULL) SELECT series, count(*) AS samples, median(d) AS spacing, CASE WHEN (max(d) - min(d)) / median(d) <= 0.002 THEN 'constant' ELSE 'variable' END AS timeline FROM x GROUP BY 1")
def timeline(spark, d):
    return series.timeline(grid(spark, d, 3600).where("v is not null"))


@query("strided_samples", f"{g()} SELECT series, i, v FROM g WHERE i % 4 = 0 AND i BETWEEN 16 AND 200")
def strided_samples(spark, d):
    return strided(grid(spark, d), 2.0, 8.0, 16, 200, time="i")


@query("theil_sen", f"{g()}, a AS (SELECT series, i, v, row_number() OVER ({W}) AS r FROM g) SELECT x.series, x.i, round(median((q.v - p.v) / (q.r - p.r)), 6) AS slope FROM a x JOIN a p ON p.series = x.series AND p.r BETWEEN x.r - 5 AND x.r JOIN a q ON q.series = x.series AND q.r BETWEEN x.r - 5 AND x.r AND p.r < q.r WHERE x.r > 5 GROUP BY 1, 2 HAVING count(*) = 15 AND count(p.v) = 15 AND count(q.v) = 15")
def theil_sen(spark, d):
    return series.theil_sen(grid(spark, d), "v", 5).where("slope is not null").select("series", "i", *r6("slope"))


# ---- patterns ----------------------------------------------------------------------------------


@query("runs", f"{g()}, {runs_sql('r', 'g', 'v > 50')} SELECT * FROM r")
def runs(spark, d):
    return patterns.runs(grid(spark, d), F.col("v") > 50)


@query("lost_spans", f"{g(3600)}, {runs_sql('r', 'g', 'v IS NULL')} SELECT * FROM r WHERE b - a + 1 >= 2")
def lost_spans(spark, d):
    return patterns.lost_spans(grid(spark, d, 3600), F.col("v").isNull(), 2)


@query("reseed_attempts", f"{g(3600)}, {runs_sql('r', 'g', 'v IS NULL')} SELECT series, a, b, n, row_number() OVER (PARTITION BY series ORDER BY a) AS attempt FROM r QUALIFY attempt <= 5")
def reseed_attempts(spark, d):
    return tracks.reseeds(patterns.lost_spans(grid(spark, d, 3600), F.col("v").isNull(), 1))


SHAPE = """CASE WHEN {0} > 0.08 THEN 'rising' WHEN {0} < -0.08 THEN 'falling' WHEN {0} IS NOT NULL THEN 'flat' END"""


@query(
    "shape_classify",
    f"{g()}, {_trend(8)}, x AS (SELECT series, i, before, after, {SHAPE.format('before')} AS a, {SHAPE.format('after')} AS b FROM t) SELECT series, i, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ' then ' || b END AS shape, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b AND a <> 'flat' THEN CASE WHEN abs(after) / abs(before) > 1.5 THEN 'speeds up' WHEN abs(after) / abs(before) < 1 / 1.5 THEN 'slows down' ELSE '' END ELSE '' END AS detail FROM x",
)
def shape_classify(spark, d):
    name, detail = patterns.shape()
    return trends(spark, d).select("series", "i", name.alias("shape"), detail.alias("detail"))


@query("knee_windows", f"{g()}, {_trend(8)}, {runs_sql('r', 't', 'abs(before) < 0.15 AND after >= 0.2')} SELECT * FROM r")
def knee_windows(spark, d):
    return patterns.runs(trends(spark, d), patterns.knee("rising", flat=0.15, steep=0.2))


@query("dip_then_rise", f"{g()}, {_trend(8)}, {runs_sql('r', 't', 'before < 0.08 AND after >= 0.25')} SELECT * FROM r")
def dip_then_rise(spark, d):
    return patterns.runs(trends(spark, d), patterns.dip_then_rise())


@query(
    "big_drops",
    f"""{g()}, {SPREAD}, sl AS (SELECT series, i, v, CASE WHEN lag(i) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(i) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w + 0 * v - lag(v) OVER w) / 2 END AS s FROM g WINDOW w AS ({W})),
t AS (SELECT sl.*, spread, lag(s) OVER w AS l, lead(s) OVER w AS r, coalesce(s < -0.1 * spread, false) AS fall FROM sl JOIN sp USING (series) WINDOW w AS ({W})),
u AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY series, fall ORDER BY i) AS grp FROM t)
SELECT series, min(i) AS onset, min(CASE WHEN s <= l AND s <= r THEN i END) AS steepest, max(i) AS bottom, round(arg_min(v, i) - arg_max(v, i), 5) AS drop_size FROM u WHERE fall GROUP BY series, grp HAVING min(CASE WHEN s <= l AND s <= r THEN i END) IS NOT NULL AND arg_min(v, i) - arg_max(v, i) >= 0.5 * max(spread) AND max(i) - min(i) <= 25""",
)
def big_drops(spark, d):
    return patterns.big_drops(series.with_spread(grid(spark, d))).select("series", "onset", "steepest", "bottom", F.round("drop", 5).alias("drop_size"))


@query(
    "excursions",
    f"""{g()}, {SPREAD}, n AS (SELECT series, i, v, row_number() OVER ({W}) AS k FROM g WHERE v IS NOT NULL), x AS (SELECT n.*, spread, v - lag(v) OVER w AS l, v - lead(v) OVER w AS r FROM n JOIN sp USING (series) WINDOW w AS (PARTITION BY series ORDER BY k)),
p AS (SELECT * FROM x WHERE l > 0 AND r > 0),
b AS (SELECT p.series, p.k, p.i, p.v, p.spread, coalesce((SELECT max(k) FROM n WHERE n.series = p.series AND n.k < p.k AND n.v > p.v), 0) AS lk, coalesce((SELECT min(k) FROM n WHERE n.series = p.series AND n.k > p.k AND n.v > p.v), 1000000) AS rk FROM p),
c AS (SELECT b.*, (SELECT min(v) FROM n WHERE n.series = b.series AND n.k > lk AND n.k <= b.k) AS lb, (SELECT min(v) FROM n WHERE n.series = b.series AND n.k < rk AND n.k >= b.k) AS rb FROM b)
SELECT series, (SELECT max(i) FROM x WHERE x.series = c.series AND x.k < c.k AND (x.l IS NULL OR x.l <= 0)) AS start, i AS apex, (SELECT min(i) FROM x WHERE x.series = c.series AND x.k > c.k AND (x.r IS NULL OR x.r <= 0)) AS finish, round(v - greatest(lb, rb), 6) AS prominence FROM c WHERE v - greatest(lb, rb) >= 0.5 * spread""",
)
def excursions(spark, d):
    return patterns.excursions(series.with_spread(grid(spark, d))).select("series", "start", "apex", "finish", *r6("prominence"))


@query("dump_stretches", f"{g()}, {runs_sql('r', 'g', 'v > 45')} SELECT series, a, b, n FROM (SELECT *, max(b - a) OVER (PARTITION BY series) AS m FROM r) WHERE b - a >= 0.5 * m")
def dump_stretches(spark, d):
    return patterns.long_stretches(patterns.runs(grid(spark, d), F.col("v") > 45))


@query("open_stretches", f"{g()}, {runs_sql('r', 'g', 'v > 45')}, e AS (SELECT series, a, b FROM r UNION ALL SELECT series, min(i), min(i) FROM g GROUP BY 1 UNION ALL SELECT series, max(i), max(i) FROM g GROUP BY 1), n AS (SELECT series, b AS a, lead(a) OVER (PARTITION BY series ORDER BY a, b) AS b FROM e) SELECT * FROM n WHERE b > a")
def open_stretches(spark, d):
    rows = grid(spark, d)
    return patterns.open_stretches(patterns.runs(rows, F.col("v") > 45), rows.groupBy("series").agg(F.min("i").alias("first"), F.max("i").alias("last")))


@query("climb_start", f"{g()}, x AS (SELECT *, min(v) OVER (PARTITION BY series) AS lo, max(v) OVER (PARTITION BY series) AS hi, lag(v) OVER ({W}) AS p FROM g), y AS (SELECT *, max(CASE WHEN p < (lo + hi) / 2 AND v >= (lo + hi) / 2 THEN i END) OVER (PARTITION BY series) AS k FROM x) SELECT series, max(k) AS crossing, coalesce(max(CASE WHEN v <= lo + 0.1 * (hi - lo) AND i <= k THEN i END), min(i)) AS climb_start FROM y GROUP BY 1")
def climb_start(spark, d):
    return patterns.climb_start(grid(spark, d))


# ---- joins in time -----------------------------------------------------------------------------


@query("asof_latest", "SELECT l.user_id, l.ts, l.event_id, r.ts AS asof_ts, r.value AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_latest(spark, d):
    events = load(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return intervals.asof_latest(left, events.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "ts", ["value"])


@query("first_after_anchor", f"{g()}, {runs_sql('r', 'g', 'v < 45')}, {runs_sql('e', 'g', 'v > 55')} SELECT r.series, r.a AS anchor, r.n AS n, (SELECT min(e.a) FROM e WHERE e.series = r.series AND e.a >= r.a) AS a, (SELECT arg_min(e.b, e.a) FROM e WHERE e.series = r.series AND e.a >= r.a) AS b FROM r")
def first_after_anchor(spark, d):
    rows = grid(spark, d)
    anchors = patterns.runs(rows, F.col("v") < 45).select("series", F.col("a").alias("anchor"), "n")
    return intervals.first_after(anchors, patterns.runs(rows, F.col("v") > 55).select("series", "a", "b"), "a")


_TWO = f"{g()}, {runs_sql('p', 'g', 'v > 50')}, {runs_sql('q', 'g', 'i % 11 < 3')}"


def _two(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = grid(spark, d)
    return rows, patterns.runs(rows, F.col("v") > 50), patterns.runs(rows, F.col("i") % 11 < 3)


@query("interval_overlap", f"{_TWO} SELECT p.series, p.a, p.b, q.a AS other_a, q.b AS other_b FROM p JOIN q ON p.series = q.series AND p.a <= q.b AND p.b >= q.a")
def interval_overlap(spark, d):
    _, p, q = _two(spark, d)
    return intervals.overlapping(p, q, bucket=16)


@query("overlap_anti", f"{_TWO} SELECT p.series, p.a, p.b, p.n FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE p.series = q.series AND p.a <= q.b AND p.b >= q.a)")
def overlap_anti(spark, d):
    _, p, q = _two(spark, d)
    return intervals.not_overlapping(p, q)


_SPANS = f"{_TWO}, w AS (SELECT series, a, b, 3 AS weight FROM p UNION ALL SELECT series, a, b, 2 AS weight FROM q), x AS (SELECT g.series, g.i, CAST(coalesce(sum(weight), 0) AS BIGINT) AS votes FROM g LEFT JOIN w ON w.series = g.series AND g.i BETWEEN w.a AND w.b GROUP BY 1, 2)"


def _voted(spark, d) -> DataFrame:
    rows, p, q = _two(spark, d)
    return intervals.votes(rows, p.select("series", "a", "b", F.lit(3).alias("weight")).union(q.select("series", "a", "b", F.lit(2).alias("weight"))))


@query("point_in_interval_vote", f"{_SPANS} SELECT * FROM x")
def point_in_interval_vote(spark, d):
    return _voted(spark, d)


@query("majority_window", f"{_SPANS}, {runs_sql('mj', 'x', 'votes > 2.5')} SELECT series, min(a) AS a, arg_min(b, a) AS b, false AS weak FROM mj GROUP BY 1")
def majority_window(spark, d):
    return intervals.majority(_voted(spark, d), 5.0)


@query("repeats_on_grid", f"{g(3600)}, k AS (SELECT series, CAST(i AS DOUBLE) AS t, min(i) OVER (PARTITION BY series) AS f FROM g WHERE v IS NOT NULL) SELECT series, t, CAST(coalesce(lead(ceil((t - f) / 0.4 - 1e-6)) OVER (PARTITION BY series ORDER BY t) - ceil((t - f) / 0.4 - 1e-6), 1) AS BIGINT) AS shown FROM k")
def repeats_on_grid(spark, d):
    return intervals.repeats_on_grid(grid(spark, d, 3600).where("v is not null").select("series", F.col("i").cast("double").alias("t")), 0.4)


# ---- cycles ------------------------------------------------------------------------------------

_PHASE = "CASE event_type WHEN 'signup' THEN 'digging' WHEN 'view' THEN 'hauling' WHEN 'click' THEN 'dumping' WHEN 'purchase' THEN 'swinging' END"
_CYCLES = f"""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS clip, {_PHASE} AS phase, epoch(ts) AS time FROM events WHERE event_type <> 'error'),
c AS (SELECT *, CASE phase WHEN 'digging' THEN 1 WHEN 'hauling' THEN 2 WHEN 'dumping' THEN 3 ELSE 4 END AS p, sum(CAST(phase = 'digging' AS INT)) OVER (PARTITION BY clip ORDER BY time, phase ROWS UNBOUNDED PRECEDING) AS c FROM s),
k AS (SELECT clip, c, min(time) AS start, string_agg(CAST(p AS VARCHAR), '' ORDER BY time, phase) AS seq, count(*) AS n, min(CASE WHEN p = 1 THEN time END) AS t1, min(CASE WHEN p = 2 THEN time END) AS t2, min(CASE WHEN p = 3 THEN time END) AS t3, min(CASE WHEN p = 4 THEN time END) AS t4 FROM c WHERE c > 0 GROUP BY 1, 2),
e AS (SELECT *, lead(start) OVER (PARTITION BY clip ORDER BY c) AS end_time FROM k),
y AS (SELECT clip, start, end_time, end_time - start AS duration, t2 - t1 AS digging, t3 - t2 AS hauling, t4 - t3 AS dumping, end_time - t4 AS swinging FROM e WHERE end_time IS NOT NULL AND n >= 3 AND seq IN ('1234', '123', '124', '134', '234'))"""


def starts(spark, d) -> DataFrame:
    """Every event but errors is a phase start of its user."""
    phase = F.create_map(*[F.lit(x) for pair in (("signup", "digging"), ("view", "hauling"), ("click", "dumping"), ("purchase", "swinging")) for x in pair])
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    return load(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").cast("string").alias("clip"), phase[F.col("event_type")].alias("phase"), micros.alias("time"))


@query("assemble_cycles", f"{_CYCLES} SELECT clip, " + ", ".join(f"round({c}, 3) AS {c}" for c in ("start", "end_time", "duration", *cycles.PHASES)) + " FROM y")
def assemble_cycles(spark, d):
    return cycles.assemble(starts(spark, d)).select("clip", *(F.round(c, 3).alias(c) for c in ("start", "end_time", "duration", *cycles.PHASES)))


@query("phase_averages", f"{_CYCLES}, l AS (SELECT DISTINCT clip FROM s) SELECT l.clip, count(y.clip) AS cycle_count, round_even(coalesce(avg(duration), 0), 3) AS cycle_seconds, " + ", ".join(f"round_even(coalesce(avg({p}), 0), 3) AS {p}_seconds" for p in cycles.PHASES) + " FROM l LEFT JOIN y ON l.clip = y.clip GROUP BY 1")
def phase_averages(spark, d):
    rows = starts(spark, d)
    return cycles.averages(cycles.assemble(rows), rows)


@query("answer_fields", f"{_CYCLES}, a AS (SELECT clip, count(*) AS n, avg(duration) AS c, avg(digging) AS d1, avg(hauling) AS d2, avg(dumping) AS d3, avg(swinging) AS d4 FROM y GROUP BY 1) SELECT clip, field, round_even(value, 3) AS value FROM (SELECT clip, 'cycle_count' AS field, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT clip, 'average_cycle_duration_seconds', c FROM a UNION ALL " + " UNION ALL ".join(f"SELECT clip, 'average_phase_duration_seconds.{p}', coalesce(d{k + 1}, 0) FROM a" for k, p in enumerate(cycles.PHASES)) + ")")
def answer_fields(spark, d):
    return cycles.fields(cycles.answer_json(cycles.averages(cycles.assemble(starts(spark, d))))).select("clip", "field", "value")


@query("tolerance_score", "SELECT clip, field, expected, actual, round(actual - expected, 6) AS error, coalesce(CASE WHEN field = 'cycle_count' THEN actual = expected ELSE abs(actual - expected) <= 0.6 END, false) AS passed FROM (SELECT e.clip, e.field, e.expected, a.actual FROM (SELECT CAST(o_orderkey AS VARCHAR) AS clip, CASE WHEN o_orderkey % 3 = 0 THEN 'cycle_count' ELSE 'x' END AS field, CAST(o_orderkey % 7 AS DOUBLE) AS expected FROM orders) e LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS clip, CASE WHEN o_orderkey % 3 = 0 THEN 'cycle_count' ELSE 'x' END AS field, CAST((o_orderkey % 7) + (o_orderkey % 5) * 0.25 AS DOUBLE) AS actual FROM orders WHERE o_orderkey % 11 <> 0) a USING (clip, field))")
def tolerance_score(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    field = F.when(F.col("k") % 3 == 0, "cycle_count").otherwise("x").alias("field")
    clip = F.col("k").cast("string").alias("clip")
    expected = o.select(clip, field, (F.col("k") % 7).cast("double").alias("value"))
    actual = o.where("k % 11 <> 0").select(clip, field, (F.col("k") % 7 + F.col("k") % 5 * 0.25).alias("value"))
    return cycles.score(expected, actual).withColumn("error", F.round("error", 6))


_LEVELS = f"""{g(86400, 'user_id')}, {runs_sql('e1', 'g', 'v < 25')}, {runs_sql('e2', 'g', 'v >= 25 AND v < 45')}, {runs_sql('e3', 'g', 'v >= 70')}, {runs_sql('e4', 'g', 'v >= 45 AND v < 70')},
ev AS (SELECT series, 0 AS k, a, b FROM e1 UNION ALL SELECT series, 1, a, b FROM e2 UNION ALL SELECT series, 2, a, b FROM e3 UNION ALL SELECT series, 3, a, b FROM e4)"""


@query(
    "phase_search",
    f"""{_LEVELS.replace('WITH ', 'WITH RECURSIVE ', 1)}, r AS (SELECT DISTINCT series, -1 AS n, -1e9::DOUBLE AS pos, 0 AS step, -1 AS k, 0 AS a, 0 AS b, 0 AS back, false AS done FROM ev
UNION ALL SELECT series, n + 1, CASE WHEN e IS NULL THEN pos ELSE e.b + 1e-3 END, CASE WHEN e IS NULL THEN step ELSE (t + 1) % 4 END, CASE WHEN e IS NULL THEN step ELSE t END, e.a, e.b, CASE WHEN again THEN step ELSE 0 END, e IS NULL
FROM (SELECT *, CASE WHEN again THEN anew WHEN late THEN NULL ELSE mine END AS e, CASE WHEN again THEN 0 ELSE step END AS t FROM (SELECT *, anew IS NOT NULL AND (mine IS NULL OR late OR anew.a < mine.a) AS again FROM (SELECT *, coalesce(step > 0 AND mine.a - pos > 10, false) AS late
FROM (SELECT r.*, (SELECT min({{'a': ev.a, 'b': ev.b}}) FROM ev WHERE ev.series = r.series AND ev.k = r.step AND ev.a >= r.pos) AS mine, CASE WHEN step > 0 THEN (SELECT min({{'a': ev.a, 'b': ev.b}}) FROM ev WHERE ev.series = r.series AND ev.k = 0 AND ev.a >= r.pos) END AS anew FROM r WHERE NOT done)))))
SELECT series, CAST(n AS INTEGER) AS nth, ['digging', 'hauling', 'dumping', 'swinging'][k + 1] AS phase, CASE WHEN NOT done THEN (a + b) / 2 END AS time, CASE WHEN NOT done THEN CAST(a AS DOUBLE) END AS win_a, CASE WHEN NOT done THEN CAST(b AS DOUBLE) END AS win_b, CASE WHEN NOT done THEN false END AS weak,
CASE WHEN NOT done THEN EXISTS (SELECT 1 FROM r o WHERE o.series = r.series AND o.n > r.n AND o.n - o.back <= r.n) END AS abandoned, CASE WHEN done THEN ['digging', 'hauling', 'dumping', 'swinging'][k + 1] END AS stop FROM r WHERE n >= 0""",
)
def phase_search(spark, d):
    rows = grid(spark, d, 86400, "user_id")
    levels = [("digging", F.col("v") < 25), ("hauling", (F.col("v") >= 25) & (F.col("v") < 45)), ("dumping", F.col("v") >= 70), ("swinging", (F.col("v") >= 45) & (F.col("v") < 70))]
    events = None
    for name, hit in levels:
        one = patterns.runs(rows, hit).select("series", F.lit(name).alias("phase"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), F.when(F.col("n") > 1, 1.0).otherwise(0.6).alias("strength"))
        events = one if events is None else events.union(one)
    return search.phase_search(events, longest_wait=10.0)


def made_up_signals(spark, d) -> DataFrame:
    """Daily means of a user's event types, one type a place, stand for the signals of a clip."""
    rows = grid(spark, d, 86400, "user_id")
    day = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 86400).cast("long")
    kinds = {"height": "view", "pos": "click", "aspect": "purchase", "over": "error", "cabin": "signup"}
    daily = load(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("series"), day.alias("day")).agg(*(F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6).alias(name) for name, kind in kinds.items()))
    daily = daily.withColumn("i", F.col("day") - F.min("day").over(Window.partitionBy("series"))).drop("day")
    wide = rows.join(daily, ["series", "i"], "left").select("series", "i", *(F.coalesce(F.col(name), F.col("v"), F.lit(50.0)).alias(name) for name in kinds))
    for source, out in (("height", "dh"), ("pos", "dpos"), ("aspect", "daspect"), ("cabin", "dx")):
        wide = series.derivative(wide, source, out, 2)
    rate = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 100
    return wide.select(
        "series", F.col("i").cast("double").alias("t"), (F.col("height") / 100).alias("height"), rate("dh").alias("dh_dt"), rate("dx").alias("dx_dt"), F.hypot(rate("dx"), rate("dh")).alias("speed_2d"),
        F.when(F.col("over") > 60, 1.0).otherwise(0.0).alias("over"), (0.5 + F.col("aspect") / 100).alias("aspect_ratio"), rate("daspect").alias("aspect_ratio_dt"),
        (F.col("pos") / 60).alias("pile_truck_pos"), (rate("dpos") * 100 / 60).alias("pile_truck_pos_dt"), (F.col("cabin") / 200).alias("cabin_pile_truck_pos"),
    )


@query("phase_starts")
def phase_starts(spark, d):
    return phases.phase_starts(made_up_signals(spark, d))


@query("phase_gaps")
def phase_gaps(spark, d):
    return phases.phase_gaps(made_up_signals(spark, d))


@query("running_phase", f"{_CYCLES}, l AS (SELECT CAST(user_id AS VARCHAR) AS clip, epoch(ts) AS t, event_id FROM events WHERE event_type = 'error') SELECT l.clip, l.event_id, s.phase, round(l.t - s.time, 3) AS running_for FROM l ASOF LEFT JOIN s ON l.clip = s.clip AND l.t + 1e-6 >= s.time")
def running_phase(spark, d):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    instants = load(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("clip"), micros.alias("t"), "event_id")
    return intervals.running(starts(spark, d), instants).select("clip", "event_id", "phase", F.round("running_for", 3).alias("running_for"))


_RATE = f"{g()}, n AS (SELECT series, 5.0 AS noise FROM g GROUP BY 1), w AS (SELECT DISTINCT series, i - i % 20 AS a, i - i % 20 + 19 AS b FROM g)"


@query(
    "movement_start",
    f"""{_RATE}, x AS (SELECT w.series, w.a, w.b, g.i, g.v - 50 AS v FROM w JOIN g ON g.series = w.series AND g.i BETWEEN w.a AND w.b), p AS (SELECT series, a, b, max(v) AS peak FROM x GROUP BY ALL),
q AS (SELECT p.*, (SELECT min(i) FROM x WHERE x.series = p.series AND x.a = p.a AND x.v = p.peak) AS apex FROM p)
SELECT series, a, b, round(peak, 6) AS peak, CASE WHEN peak > 15 THEN coalesce((SELECT max(i) + 1 FROM x WHERE x.series = q.series AND x.a = q.a AND x.i < q.apex AND coalesce(x.v, 0) <= 15), (SELECT min(i) FROM x WHERE x.series = q.series AND x.a = q.a)) END AS start FROM q""",
)
def movement_start(spark, d):
    rows = grid(spark, d).withColumn("rate", F.col("v") - 50)
    windows = rows.select("series", (F.col("i") - F.col("i") % 20).alias("a"), (F.col("i") - F.col("i") % 20 + 19).alias("b")).distinct()
    noise = rows.select("series", F.lit(5.0).alias("noise")).distinct()
    return search.movement_start(rows, windows, "rate", noise).select("series", "a", "b", *r6("peak"), "start")


@query("gate_open", f"{g()} SELECT series, min(CASE WHEN v > 60 AND i >= 10 THEN i END) AS opened, CAST(greatest(10.0, min(CASE WHEN v > 60 AND i >= 10 THEN i END) - 1.0) AS DOUBLE) AS cue_from FROM g GROUP BY 1")
def gate_open(spark, d):
    out = search.gate_opening(grid(spark, d), F.col("v") > 60, F.lit(10.0))
    return out.withColumn("cue_from", F.col("cue_from").cast("double"))


_PLACES = f"{g()}, h AS (SELECT series, i, v AS height, v - 50 AS x, CAST(i % 17 AS DOUBLE) AS y, CASE WHEN v > 60 THEN 1.0 ELSE 0.0 END AS over_t FROM g), c AS (SELECT series, quantile_cont(height, 0.1) AS cut FROM h GROUP BY 1), a AS (SELECT h.series, median(x) AS px, median(y) AS py FROM h JOIN c USING (series) WHERE height <= cut AND over_t <= 0 GROUP BY 1)"


def places(spark, d) -> DataFrame:
    return grid(spark, d).select("series", "i", F.col("v").alias("height"), (F.col("v") - 50).alias("x"), (F.col("i") % 17).cast("double").alias("y"), F.when(F.col("v") > 60, 1.0).otherwise(0.0).alias("over"))


@query("pile_truck_axis", f"{_PLACES} SELECT series, i, round(((x - px) * -px + (y - py) * -py) / (px * px + py * py), 6) AS pos FROM h JOIN a USING (series)")
def pile_truck_axis(spark, d):
    rows = places(spark, d)
    return search.projected(rows, search.axis(rows)).select("series", "i", *r6("pos"))


@query("truck_side", f"{_PLACES} SELECT series, CASE WHEN coalesce(median(CASE WHEN over_t > 0 THEN x END), 0) >= 0 THEN 1 ELSE -1 END AS side FROM h GROUP BY 1")
def truck_side(spark, d):
    return search.side(places(spark, d))


@query("rank_search", f"{g()}, {_trend(8)}, x AS (SELECT series, {SHAPE.format('before')} AS a, {SHAPE.format('after')} AS b FROM t) SELECT a || ' then ' || b AS shape, count(*) AS hits, count(DISTINCT series) AS in_series FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 ORDER BY hits DESC, shape LIMIT 5")
def rank_search(spark, d):
    name, _ = patterns.shape()
    ranked = trends(spark, d).select("series", name.alias("shape")).where("shape is not null").groupBy("shape").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("series").alias("in_series"))
    return ranked.orderBy(F.desc("hits"), "shape").limit(5)


# ---- masks and boxes ---------------------------------------------------------------------------

_PIX = "WITH px AS (SELECT l_returnflag AS clip, l_suppkey AS sample, CAST(l_quantity AS BIGINT) AS x, CAST(l_linenumber AS BIGINT) AS y FROM lineitem)"
_CORE = f"{_PIX}, o AS (SELECT clip, y, x, count(DISTINCT sample) * 1.0 / (SELECT count(DISTINCT sample) FROM px q WHERE q.clip = px.clip) AS occ FROM px GROUP BY clip, y, x), k AS (SELECT clip, quantile_cont(occ, 0.9) AS cut FROM o GROUP BY 1), core AS (SELECT clip, y, x, occ FROM o JOIN k USING (clip) WHERE occ >= cut)"


def pixels(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_returnflag").alias("clip"), F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("long").alias("x"), F.col("l_linenumber").cast("long").alias("y"))


@query("bbox", f"{_PIX} SELECT clip, sample, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM px GROUP BY 1, 2")
def bbox(spark, d):
    return geo.bounding_boxes(pixels(spark, d))


@query("occupancy_core", f"{_CORE} SELECT clip, y, x, round(occ, 6) AS occ FROM core")
def occupancy_core(spark, d):
    return geo.stable_core(pixels(spark, d)).select("clip", "y", "x", *r6("occ"))


@query("rotation_centre", f"{_CORE} SELECT clip, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM core GROUP BY 1")
def rotation_centre(spark, d):
    return geo.rotation_centre(geo.stable_core(pixels(spark, d))).select("clip", *r6("cx", "cy"))


@query("boom_base", f"{_CORE}, u AS (SELECT clip, quantile_cont(y, 0.2) AS cut FROM core GROUP BY 1) SELECT clip, round(avg(x), 6) AS bx, round(avg(y), 6) AS by FROM core JOIN u USING (clip) WHERE y <= u.cut GROUP BY 1")
def boom_base(spark, d):
    return geo.boom_base(geo.stable_core(pixels(spark, d))).select("clip", *r6("bx", "by"))


_TIPS = f"{_PIX}, far AS (SELECT clip, sample, x, y, sqrt((x - 25.0) ** 2 + (y - 3.0) ** 2) AS reach, row_number() OVER (PARTITION BY clip, sample ORDER BY (x - 25.0) ** 2 + (y - 3.0) ** 2 DESC, y, x) AS n FROM px)"


def tips(spark, d) -> DataFrame:
    rows = pixels(spark, d)
    return geo.farthest(rows, rows.select("clip", F.lit(25.0).alias("cx"), F.lit(3.0).alias("cy")).distinct())


@query("farthest_point", f"{_TIPS} SELECT clip, sample, x, y, round(reach, 6) AS reach FROM far WHERE n = 1")
def farthest_point(spark, d):
    return tips(spark, d).select("clip", "sample", "x", "y", *r6("reach"))


@query("arm_reach", f"{_TIPS} SELECT clip, round(quantile_cont(reach, 0.95), 6) AS arm_reach FROM far WHERE n = 1 GROUP BY 1")
def arm_reach(spark, d):
    return geo.arm_reach(tips(spark, d)).select("clip", *r6("arm_reach"))


@query("containment", f"{_PIX}, o AS (SELECT DISTINCT clip, sample, y, x FROM px WHERE (x + y) % 3 = 0) SELECT px.clip, px.sample, round(count(o.x) * 1.0 / count(*), 6) AS containment FROM px LEFT JOIN o ON o.clip = px.clip AND o.sample = px.sample AND o.y = px.y AND o.x = px.x GROUP BY 1, 2")
def containment(spark, d):
    rows = pixels(spark, d)
    return geo.inner_share(rows, rows.where((F.col("x") + F.col("y")) % 3 == 0)).select("clip", "sample", *r6("containment"))


@query("mask_components")
def mask_components(spark, d):
    return masks.large_components(pixels(spark, d))


@query("geodesic_bands")
def geodesic_bands(spark, d):
    seeds = pixels(spark, d).groupBy("clip").agg(F.min("y").alias("sy"), F.min("x").alias("sx"))
    return masks.bands(masks.geodesic_distance(pixels(spark, d), seeds)).drop("reach")


@query("interior_points")
def interior_points(spark, d):
    return masks.interior_points(pixels(spark, d), 3)


@query("prompt_grid", f"{_PIX}, b AS (SELECT clip, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px GROUP BY 1) SELECT clip, r * 3 + c AS nth, CAST(round(y0 + (0.55 + 0.35 * r) * (y1 - y0), 6) AS DOUBLE) AS py, CAST(round(x0 + (0.15 + 0.35 * c) * (x1 - x0), 6) AS DOUBLE) AS px FROM b, range(2) t(r), range(3) u(c)")
def prompt_grid(spark, d):
    boxes = pixels(spark, d).groupBy("clip").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return masks.grid_points(boxes).select("clip", F.col("nth").cast("long").alias("nth"), *r6("py", "px"))


def _flags(spark, d) -> DataFrame:
    line = load(spark, d, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nr")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("hit"))


_HITS = "WITH h AS (SELECT l_suppkey AS key, l_orderkey * 10 + l_linenumber AS nr, bool_or(l_returnflag = 'R') AS hit FROM lineitem GROUP BY 1, 2)"


@query("rle_encode", f"{_HITS}, c AS (SELECT *, CASE WHEN hit <> coalesce(lag(hit) OVER (PARTITION BY key ORDER BY nr), false) THEN 1 ELSE 0 END AS change FROM h), r AS (SELECT *, sum(change) OVER (PARTITION BY key ORDER BY nr) AS run FROM c), k AS (SELECT key, run, count(*) AS n FROM r GROUP BY 1, 2) SELECT key, CASE WHEN min(run) > 0 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS rle FROM k GROUP BY 1")
def rle_encode(spark, d):
    return geo.rle_encode(_flags(spark, d), "key", "nr", F.col("hit")).select("key", F.concat_ws(",", F.transform("rle", lambda x: x.cast("string"))).alias("rle"))


@query("rle_decode", f"{_HITS} SELECT key, pos FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY nr) - 1 AS pos, hit FROM h) WHERE hit")
def rle_decode(spark, d):
    return geo.rle_decode(geo.rle_encode(_flags(spark, d), "key", "nr", F.col("hit")), "key")


_BOX = "WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_linenumber * 3.0 AS y0, l_quantity + 1 + l_discount * 100 AS x1, l_linenumber * 3.0 + 5 + l_tax * 100 AS y1 FROM lineitem), s AS (SELECT *, greatest(least(x1, 40.0) - greatest(x0, 20.0), 0) AS w, greatest(least(y1, 20.0) - greatest(y0, 5.0), 0) AS h, greatest(least(x1, 40.0) - greatest(x0, 20.0) + 1, 0) * greatest(least(y1, 20.0) - greatest(y0, 5.0) + 1, 0) AS own FROM b)"


@query("box_overlaps", f"{_BOX} SELECT l_orderkey, l_linenumber, round(own / ((x1 - x0 + 1) * (y1 - y0 + 1)), 6) AS overlap_fraction, round(w * h / ((x1 - x0) * (y1 - y0) + 300 - w * h), 6) AS iou, round(CASE WHEN (y0 + y1) / 2 < 12.5 THEN w / (x1 - x0) ELSE 0 END, 6) AS over_truck, round((x1 - x0 + 1) / (y1 - y0 + 1), 6) AS aspect FROM s")
def box_overlaps(spark, d):
    line = F.col("l_linenumber") * 3.0
    b = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), line.alias("y0"), (F.col("l_quantity") + 1 + F.col("l_discount") * 100).alias("x1"), (line + 5 + F.col("l_tax") * 100).alias("y1"))
    mine, truck = geo.box(""), tuple(map(F.lit, (20.0, 5.0, 40.0, 20.0)))
    return b.select("l_orderkey", "l_linenumber", F.round(geo.overlap_fraction(mine, truck), 6).alias("overlap_fraction"), F.round(geo.iou(mine, truck), 6).alias("iou"), F.round(geo.over_truck(mine, truck), 6).alias("over_truck"), F.round(geo.aspect_ratio(mine), 6).alias("aspect"))


# ---- track records -----------------------------------------------------------------------------

_REC = "WITH t AS (SELECT o_custkey % 20 AS clip, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS area, (o_orderkey % 100) / 100.0 AS agreement FROM orders)"


@query(
    "track_quality",
    f"""{_REC}, m AS (SELECT clip, count(*) AS samples, count_if(area > 0) AS found, median(CASE WHEN area > 0 THEN area END) AS median_area, median(agreement) AS median_agreement FROM t GROUP BY 1),
o AS (SELECT clip, count_if(area > 0 AND area > 1.8 * median_area) AS large, count_if(area > 0 AND area < 0.4 * median_area) AS small FROM t JOIN m USING (clip) GROUP BY 1)
SELECT clip, samples, found, round(median_area, 6) AS median_area, round(median_agreement, 6) AS median_agreement, large, small, round(found * 1.0 / samples, 6) AS coverage, reasons, reasons = '' AS passed FROM (SELECT *, concat_ws(',', CASE WHEN found * 1.0 / samples < 0.97 THEN 'coverage' END, CASE WHEN coalesce((large + small) * 1.0 / nullif(found, 0), 1) > 0.1 THEN 'area' END, CASE WHEN coalesce(median_agreement, 1) < 0.7 THEN 'agreement' END) AS reasons FROM m JOIN o USING (clip))""",
)
def track_quality(spark, d):
    o = load(spark, d, "orders").select((F.col("o_custkey") % 20).alias("clip"), F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice")).alias("area"), (F.col("o_orderkey") % 100 / 100.0).alias("agreement"))
    q = tracks.quality(o)
    return q.select("clip", "samples", "found", *r6("median_area", "median_agreement"), "large", "small", *r6("coverage"), "reasons", "passed")


def detections(spark, d) -> DataFrame:
    return load(spark, d, "orders").select((F.col("o_custkey") % 50).alias("clip"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 10 / 10.0).alias("iou"), *((F.col("o_orderkey") % (k + 30) + 100.0 * k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))


_DET = "WITH t AS (SELECT o_custkey % 50 AS clip, o_orderkey AS id, o_totalprice AS score, (o_orderkey % 10) / 10.0 AS iou, o_orderkey % 30 + 0.0 AS x0, o_orderkey % 31 + 100.0 AS y0, o_orderkey % 32 + 200.0 AS x1, o_orderkey % 33 + 300.0 AS y1 FROM orders)"


@query("truck_median_box", f"{_DET} SELECT clip, CAST(median(x0) AS DOUBLE) AS x0, CAST(median(y0) AS DOUBLE) AS y0, CAST(median(x1) AS DOUBLE) AS x1, CAST(median(y1) AS DOUBLE) AS y1 FROM t WHERE coalesce(iou, 0) <= 0.3 GROUP BY 1")
def truck_median_box(spark, d):
    return tracks.median_box(detections(spark, d))


@query("best_detection", f"{_DET} SELECT clip, id, score, CAST(x0 AS DOUBLE) AS x0 FROM t QUALIFY row_number() OVER (PARTITION BY clip ORDER BY score DESC, id) = 1")
def best_detection(spark, d):
    return tracks.best_detection(detections(spark, d).select("clip", "id", "score", "x0"), ["clip"])


@query("seed_choice", f"{_DET} SELECT clip, id AS sample, score, iou < 0.3 AS clean FROM t QUALIFY row_number() OVER (PARTITION BY clip ORDER BY iou < 0.3 DESC, score DESC, id) = 1")
def seed_choice(spark, d):
    return tracks.seed(detections(spark, d))


@query("missing_samples", "SELECT o_orderkey, o_orderstatus = 'P' OR coalesce((CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0 END) < 0.35, false) AS missing FROM orders")
def missing_samples(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("has_mask"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("NaN").cast("double")).otherwise(F.col("o_orderkey") % 100 / 100.0).alias("confidence"))
    return o.select("o_orderkey", tracks.missing().alias("missing"))


# ---- event time, lineage -----------------------------------------------------------------------


@query("tumbling", "SELECT event_type AS series, to_timestamp(floor(epoch(ts) / 10800) * 10800)::TIMESTAMP AS w_start, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    out = online.tumbling(load(spark, d, "events"))
    return out.withColumn("v", F.round("v", 6))


@query("session_gaps", "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l) SELECT user_id, min(ts) AS w_start, max(ts) + INTERVAL 12 HOUR AS w_end, count(*) AS n FROM s GROUP BY user_id, s")
def session_gaps(spark, d):
    return online.sessions(load(spark, d, "events"), "12 hours")


@query("config_digest", "SELECT p_partkey, left(sha256(CAST(to_json({'p_brand': p_brand, 'p_name': p_name, 'p_type': p_type}) AS VARCHAR)), 16) AS digest FROM part")
def config_digest(spark, d):
    return load(spark, d, "part").select("p_partkey", records.digest("p_type", "p_brand", "p_name").alias("digest"))
