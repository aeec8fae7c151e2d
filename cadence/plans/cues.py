"""The phase cues over signals that DuckDB can make too, each against its own SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadence.operators import phases
from cadence.plans.registry import as_sql, g, grid, query, r6
from cadence.sources.tables import load

#: signal -> (event type whose daily mean it is, how it is scaled); fixed for these queries
_SOURCES = {"height": ("view", "{} / 100"), "dh_dt": ("click", "({} - 50) / 100"), "speed_2d": ("purchase", "{} / 100"), "aspect_ratio": ("error", "0.5 + {} / 100"), "pile_truck_pos": ("signup", "{} / 60"), "pile_truck_pos_dt": ("view", "(50 - {}) / 100"), "over": ("purchase", "CASE WHEN {} > 60 THEN 1.0 ELSE 0.0 END"), "cabin_pile_truck_pos": ("click", "{} / 200"), "aspect_ratio_dt": ("signup", "(50 - {}) / 100")}


def raw_signals(spark, d, step: float = 1.0):
    """Means of a user's event types by day, as they are: rates are signals of their own here."""
    rows = grid(spark, d, 86400, "user_id")
    day = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 86400).cast("long")
    kinds = sorted({k for k, _ in _SOURCES.values()})
    daily = load(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("series"), day.alias("day")).agg(*(F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 6).alias(k) for k in kinds))
    daily = daily.withColumn("i", F.col("day") - F.min("day").over(Window.partitionBy("series"))).drop("day")
    # no two samples of a series are equal
    wide = rows.join(daily, ["series", "i"], "left").select("series", "i", *((F.coalesce(F.col(k), F.col("v"), F.lit(50.0)) + F.col("i") * 1e-4).alias(k) for k in kinds))
    made = {name: F.expr(scale.format(kind)).cast("double") for name, (kind, scale) in _SOURCES.items()}
    rest = {c: F.lit(0.0) for c in phases.SIGNALS if c not in made}
    return wide.select("series", (F.col("i") * step).cast("double").alias("t"), *(v.alias(n) for n, v in {**made, **rest}.items()))


def _signals() -> str:
    kinds = sorted({k for k, _ in _SOURCES.values()})
    means = ", ".join(f"round(avg(CASE WHEN event_type = '{k}' THEN value END), 6) AS \"{k}\"" for k in kinds)
    filled = ", ".join(f"coalesce(dy.\"{k}\", g.v, 50.0) + g.i * 1e-4 AS \"{k}\"" for k in kinds)
    made = ", ".join(f"CAST({scale.format(chr(34) + kind + chr(34))} AS DOUBLE) AS \"{name}\"" for name, (kind, scale) in _SOURCES.items())
    return f"""{g(86400, 'user_id')}, dd AS (SELECT CAST(user_id AS VARCHAR) AS series, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, {means} FROM events GROUP BY 1, 2),
dy AS (SELECT *, slot - min(slot) OVER (PARTITION BY series) AS at FROM dd), wide AS (SELECT g.series, g.i, {filled} FROM g LEFT JOIN dy ON dy.series = g.series AND dy.at = g.i),
sg AS (SELECT series, CAST(i AS DOUBLE) AS t, row_number() OVER (PARTITION BY series ORDER BY i) AS k, {made} FROM wide), sz AS (SELECT series, max(k) AS n, max(t) AS last FROM sg GROUP BY 1)"""


def _spread(name: str) -> str:
    return f"sp_{name} AS (SELECT series, CASE WHEN quantile_cont({name}, 0.95) - quantile_cont({name}, 0.05) > 0 THEN quantile_cont({name}, 0.95) - quantile_cont({name}, 0.05) ELSE 1 END AS spread FROM sg GROUP BY 1)"


def _noise(name: str) -> str:
    return f"nd_{name} AS (SELECT series, {name} - lag({name}) OVER (PARTITION BY series ORDER BY k) AS d FROM sg), nm_{name} AS (SELECT series, median(d) AS m FROM nd_{name} GROUP BY 1), no_{name} AS (SELECT series, 1.4826 * median(abs(d - m)) / sqrt(2.0) AS noise FROM nd_{name} JOIN nm_{name} USING (series) WHERE d IS NOT NULL GROUP BY 1)"


def _drops(tag: str, name: str, least: float, seconds: float) -> str:
    """tag(series, a, steep, b): places of the big falls."""
    return f"""{tag}_g AS (SELECT series, k, t, {name} AS v, CASE WHEN lag(t) OVER w IS NULL THEN lead({name}) OVER w - {name} WHEN lead(t) OVER w IS NULL THEN {name} - lag({name}) OVER w ELSE (lead({name}) OVER w - lag({name}) OVER w) / 2 END AS gr FROM sg WINDOW w AS (PARTITION BY series ORDER BY k)),
{tag}_l AS (SELECT x.*, spread, gr < -0.1 * spread AS fall, gr <= lag(gr) OVER w AND gr <= lead(gr) OVER w AS low FROM {tag}_g x JOIN sp_{name} USING (series) WINDOW w AS (PARTITION BY series ORDER BY k)),
{tag}_r AS (SELECT *, k - row_number() OVER (PARTITION BY series, fall ORDER BY k) AS grp FROM {tag}_l),
{tag} AS (SELECT series, min(k) AS a, min(CASE WHEN low THEN k END) AS steep, max(k) AS b FROM {tag}_r WHERE fall GROUP BY series, grp HAVING min(CASE WHEN low THEN k END) IS NOT NULL AND arg_min(v, k) - arg_max(v, k) >= {least} * any_value(spread) AND max(t) - min(t) <= {seconds})"""


def _peaks(tag: str, name: str, least: float, sign: int = 1) -> str:
    """tag(series, k, v, lbk, rbk, rise): tops (or dips) with their bases."""
    return f"""{tag}_x AS (SELECT series, k, {sign} * {name} AS v, {sign} * ({name} - lag({name}) OVER w) AS l, {sign} * ({name} - lead({name}) OVER w) AS r FROM sg WINDOW w AS (PARTITION BY series ORDER BY k)),
{tag}_b AS (SELECT p.*, coalesce((SELECT max(k) FROM {tag}_x x WHERE x.series = p.series AND x.k < p.k AND x.v > p.v), 0) AS lk, coalesce((SELECT min(k) FROM {tag}_x x WHERE x.series = p.series AND x.k > p.k AND x.v > p.v), 1000000) AS rk FROM {tag}_x p WHERE l > 0 AND r > 0),
{tag}_c AS (SELECT b.*, (SELECT min(v) FROM {tag}_x x WHERE x.series = b.series AND x.k > lk AND x.k <= b.k) AS lb, (SELECT min(v) FROM {tag}_x x WHERE x.series = b.series AND x.k < rk AND x.k >= b.k) AS rb FROM {tag}_b b),
{tag} AS (SELECT c.series, c.k, c.v, v - greatest(lb, rb) AS rise, (SELECT max(k) FROM {tag}_x x WHERE x.series = c.series AND x.k <= c.k AND x.k > lk AND x.v = lb) AS lbk, (SELECT min(k) FROM {tag}_x x WHERE x.series = c.series AND x.k >= c.k AND x.k < rk AND x.v = rb) AS rbk FROM {tag}_c c JOIN sp_{name} USING (series) WHERE v - greatest(lb, rb) >= {least} * spread)"""


def _sides(name: str) -> str:
    part = lambda rows: f"CASE WHEN count(*) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN {rows}) = 3 THEN regr_slope({name}, t) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN {rows}) * 2 / spread END"
    return f"sd_{name} AS (SELECT series, k, t, {part('2 PRECEDING AND CURRENT ROW')} AS before, {part('CURRENT ROW AND 2 FOLLOWING')} AS after FROM sg JOIN sp_{name} USING (series))"


def _time(k: str) -> str:
    return f"CAST({k} - 1 AS DOUBLE)"


_HAS = "(SELECT {what} FROM sg x WHERE x.series = {of}.series AND {where})"


def _first(of: str, where: str, what: str = "min(k)") -> str:
    return _HAS.format(of=of, where=where, what=what)


def _cue(name: str, ctes: list[str], select: str) -> None:
    sql = f"{_signals()}, {', '.join(ctes)} SELECT series, nth, round(a, 6) AS a, round(b, 6) AS b, round(centre, 6) AS centre FROM ({select}) WHERE a IS NOT NULL"

    @query(f"cue_{name}", sql)
    def run(spark, d):
        return phases.cue_events(raw_signals(spark, d)).where(F.col("cue") == name).select("series", "nth", *r6("a", "b", "centre"))


_DESCENT = "x.k >= {k} AND coalesce((SELECT y.{v} FROM sg y WHERE y.series = x.series AND y.k = x.k + 1) > x.{v}, true)"

# the place where speed stops falling behind its first hump
_cue("speed_min", [_spread("speed_2d"), _peaks("hp", "speed_2d", 0.5), "f AS (SELECT series, min(k) AS k FROM hp GROUP BY 1)".replace("f AS", "hf AS"), f"e AS (SELECT series, k, {_first('hf', _DESCENT.format(k='hf.k', v='speed_2d'))} AS low FROM hf)"], f"SELECT series, 0 AS nth, {_time('k')} AS a, {_time('low')} AS b, {_time('low')} AS centre FROM e")

_HD = [_spread("height"), _drops("hd", "height", 0.5, 6.0), "h1 AS (SELECT series, min(b) AS first FROM hd GROUP BY 1), h2 AS (SELECT hd.* FROM hd JOIN h1 ON h1.series = hd.series AND hd.b = first)"]
_cue("height_drop_end", _HD, f"SELECT series, 0 AS nth, {_time('a')} AS a, {_time('b')} AS b, {_time('b')} AS centre FROM h2")

_cue("dh_back_to_0", [*_HD, _noise("dh_dt"), f"e AS (SELECT h2.*, {_first('h2', 'x.k >= h2.steep AND x.dh_dt >= -noise')} AS back FROM h2 JOIN no_dh_dt USING (series))"], f"SELECT series, 0 AS nth, CASE WHEN back IS NOT NULL THEN {_time('steep')} END AS a, {_time('back')} AS b, {_time('back')} AS centre FROM e")

_PD = "pile_truck_pos_dt"
_cue(
    "dx_crossing",
    [
        _spread(_PD), _noise(_PD), _peaks("dp", _PD, 0.5, -1), "d1 AS (SELECT series, min(k) AS k FROM dp GROUP BY 1)",
        f"d2 AS (SELECT d1.series, {_first('d1', f'x.k >= d1.k AND x.{_PD} >= -noise')} AS up FROM d1 JOIN no_{_PD} USING (series))",
        f"d3 AS (SELECT *, {_first('d2', f'x.k >= d2.up AND coalesce((SELECT y.{_PD} FROM sg y WHERE y.series = x.series AND y.k = x.k + 1) < x.{_PD}, true)')} AS top FROM d2)",
        f"e AS (SELECT *, {_first('d3', _DESCENT.format(k='d3.top', v=_PD))} AS low FROM d3)",
    ],
    f"SELECT series, 0 AS nth, {_time('up')} AS a, {_time('low')} AS b, {_time('up')} AS centre FROM e",
)

_PP = "pile_truck_pos"
_cue(
    "x_drop_end",
    [
        _spread(_PP), _noise(_PP), _drops("xd", _PP, 0.5, 6.0), "x1 AS (SELECT series, min(b) AS first FROM xd GROUP BY 1), x2 AS (SELECT xd.*, noise FROM xd JOIN x1 ON x1.series = xd.series AND xd.b = first JOIN no_pile_truck_pos n ON n.series = xd.series)",
        f"x3 AS (SELECT *, {_first('x2', f'x.k >= x2.b AND coalesce((SELECT y.{_PP} FROM sg y WHERE y.series = x.series AND y.k = x.k + 1) > x.{_PP} + x2.noise, true)')} AS stop FROM x2)",
        f"x4 AS (SELECT *, {_first('x3', 'x.k BETWEEN x3.b AND x3.stop', f'arg_min(k, {_PP})')} AS low FROM x3)",
        f"x5 AS (SELECT x4.*, p.{_PP} AS v_low, q.{_PP} AS v_on FROM x4 JOIN sg p ON p.series = x4.series AND p.k = x4.low JOIN sg q ON q.series = x4.series AND q.k = x4.a)",
        f"e AS (SELECT x5.series, last, coalesce({_first('x5', f'x.k BETWEEN x5.a AND x5.low AND x.{_PP} <= x5.v_low + 0.1 * (x5.v_on - x5.v_low)')}, x5.low) AS home FROM x5 JOIN sz USING (series))",
    ],
    f"SELECT series, 0 AS nth, {_time('home')} AS a, least({_time('home')} + 2.4, last) AS b, {_time('home')} AS centre FROM e",
)

_cue("tip", [_spread("aspect_ratio"), _drops("ad", "aspect_ratio", 0.3, 2.5)], f"SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY a) - 1 AS INTEGER) AS nth, {_time('a')} AS a, {_time('b')} AS b, {_time('steep')} AS centre FROM ad")

_FALL = "fl AS (SELECT series, min(a) AS fall FROM hd GROUP BY 1)"
_cue(
    "height_second_hump",
    [
        *_HD, _FALL, _peaks("ht", "height", 0.03), "t1 AS (SELECT fl.series, max(ht.k) AS top FROM fl JOIN ht ON ht.series = fl.series AND ht.k <= fall GROUP BY 1)",
        "t2 AS (SELECT t1.series, top, greatest(coalesce((SELECT max(k) FROM ht WHERE ht.series = t1.series AND ht.k < top), 1), 1) AS lo FROM t1)",
        f"t3 AS (SELECT t2.*, {_first('t2', 'x.k BETWEEN t2.lo AND t2.top', 'min(height)')} AS base, {_first('t2', 'x.k = t2.top', 'max(height)')} AS high FROM t2)",
        f"t4 AS (SELECT *, coalesce({_first('t3', 'x.k BETWEEN t3.lo AND t3.top AND NOT x.height > t3.base + 0.1 * (t3.high - t3.base)', 'max(k)')}, lo) AS q FROM t3)",
        f"t5 AS (SELECT *, coalesce({_first('t4', 'x.k BETWEEN t4.q AND t4.top AND x.height >= t4.base + 0.5 * (t4.high - t4.base)')}, q) AS m FROM t4)",
        f"e AS (SELECT *, coalesce({_first('t5', 'x.k BETWEEN t5.m AND t5.top AND x.height >= t5.base + 0.9 * (t5.high - t5.base)')}, top) AS near FROM t5)",
    ],
    f"SELECT series, 0 AS nth, {_time('q')} AS a, {_time('near')} AS b, {_time('q')} AS centre FROM e",
)

_cue(
    "height_peak",
    [
        *_HD, _FALL, _peaks("ht", "height", 0.15),
        f"w1 AS (SELECT ht.*, v - rise * 0.5 AS level FROM ht), w2 AS (SELECT *, coalesce({_first('w1', 'x.k BETWEEN w1.lbk AND w1.k AND x.height <= w1.level', 'max(k)')}, lbk) AS ak, coalesce({_first('w1', 'x.k BETWEEN w1.k AND w1.rbk AND x.height <= w1.level')}, rbk) AS bk FROM w1)",
        "w3 AS (SELECT w2.*, bk - CASE WHEN b0.height < level THEN (level - b0.height) / (b1.height - b0.height) ELSE 0 END - (ak + CASE WHEN a0.height < level THEN (level - a0.height) / (a1.height - a0.height) ELSE 0 END) AS width FROM w2 JOIN sg a0 ON a0.series = w2.series AND a0.k = ak JOIN sg a1 ON a1.series = w2.series AND a1.k = ak + 1 JOIN sg b0 ON b0.series = w2.series AND b0.k = bk JOIN sg b1 ON b1.series = w2.series AND b1.k = bk - 1)",
        "t1 AS (SELECT fl.series, max(w3.k) AS top FROM fl JOIN w3 ON w3.series = fl.series AND w3.k <= fall AND width >= 2.0 GROUP BY 1), t2 AS (SELECT t1.series, top, lbk AS lo FROM t1 JOIN w3 ON w3.series = t1.series AND w3.k = top)",
        f"t3 AS (SELECT t2.*, {_first('t2', 'x.k BETWEEN t2.lo AND t2.top', 'min(height)')} AS base, {_first('t2', 'x.k = t2.top', 'max(height)')} AS high FROM t2)",
        f"e AS (SELECT *, coalesce({_first('t3', 'x.k BETWEEN t3.lo AND t3.top AND x.height >= t3.base + 0.8 * (t3.high - t3.base)')}, top) AS near FROM t3)",
    ],
    f"SELECT series, 0 AS nth, {_time('near')} AS a, {_time('top')} AS b, {_time('near')} AS centre FROM e",
)


def _runs(tag: str, source: str, hit: str) -> str:
    return f"{tag}_h AS (SELECT series, k, coalesce({hit}, false) AS hit FROM {source}), {tag} AS (SELECT series, min(k) AS a, max(k) AS b FROM (SELECT *, k - row_number() OVER (PARTITION BY series, hit ORDER BY k) AS grp FROM {tag}_h) WHERE hit GROUP BY series, grp)"


_cue(
    "x_takeoff",
    [_spread(_PP), _sides(_PP), _runs("up", f"sd_{_PP}", "abs(before) < 0.08 AND after >= 0.25"), _runs("down", f"sd_{_PP}", "abs(before) < 0.08 AND -after >= 0.25"), "e AS (SELECT * FROM (SELECT * FROM up UNION ALL SELECT * FROM down) QUALIFY row_number() OVER (PARTITION BY series ORDER BY a, b) = 1)"],
    f"SELECT series, 0 AS nth, {_time('a')} AS a, {_time('b')} AS b, ({_time('a')} + {_time('b')}) / 2 AS centre FROM e",
)

_cue(
    "truck_x_takeoff",
    [
        _spread(_PP), _sides(_PP), f"kn AS (SELECT s.*, x.{_PP} < 1 AS before_truck FROM sd_{_PP} s JOIN sg x ON x.series = s.series AND x.k = s.k)", _runs("sharp", "kn", "abs(before) < 0.08 AND after >= 0.25 AND before_truck"), _runs("loose", "kn", "abs(before) < 2 * 0.08 AND after >= 0.25 / 2 AND before_truck"),
        "s1 AS (SELECT * FROM sharp QUALIFY row_number() OVER (PARTITION BY series ORDER BY a) = 1), e AS (SELECT s1.series, coalesce(least(s1.a, min(l.a)), s1.a) AS a, coalesce(greatest(s1.b, arg_min(l.b, l.a)), s1.b) AS b FROM s1 LEFT JOIN loose l ON l.series = s1.series AND l.a <= s1.b AND l.b >= s1.a GROUP BY s1.series, s1.a, s1.b)",
    ],
    f"SELECT series, 0 AS nth, {_time('a')} AS a, {_time('b')} AS b, ({_time('a')} + {_time('b')}) / 2 AS centre FROM e",
)

_cue(
    "dh_positive_falling",
    [
        _noise("dh_dt"), "gr AS (SELECT series, k, dh_dt, CASE WHEN lag(t) OVER w IS NULL THEN lead(dh_dt) OVER w - dh_dt WHEN lead(t) OVER w IS NULL THEN dh_dt - lag(dh_dt) OVER w ELSE (lead(dh_dt) OVER w - lag(dh_dt) OVER w) / 2 END AS slope FROM sg WINDOW w AS (PARTITION BY series ORDER BY k)), gn AS (SELECT gr.*, noise FROM gr JOIN no_dh_dt USING (series))",
        _runs("pf", "gn", "dh_dt > noise AND slope < 0"), "e AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY series ORDER BY a) = 1)",
    ],
    f"SELECT series, 0 AS nth, {_time('a')} AS a, {_time('b')} AS b, ({_time('a')} + {_time('b')}) / 2 AS centre FROM e",
)


# ---- gates, stretches, widths, starts ----------------------------------------------------------


@query(
    "phase_gates",
    f"""{_signals()}, lv AS (SELECT series, median(CASE WHEN t BETWEEN 5 AND 12 THEN height END) AS level FROM sg GROUP BY 1)
SELECT series, t, sg.over <= 0 AND pile_truck_pos < 1 AS digging, coalesce(height > level AND sg.over <= 0, false) AS hauling, coalesce(pile_truck_pos - cabin_pile_truck_pos > 0 AND height > level, false) AS dumping FROM sg JOIN lv USING (series)""".replace("sg.over", 'sg."over"'),
)
def phase_gates(spark, d):
    return phases.gates(raw_signals(spark, d), 5, 12)


_OPEN = f"""{_signals()}, {_noise('speed_2d')}, {_runs('vs', 'sg', '"over" > 0')}, vl AS (SELECT * FROM (SELECT *, max(b - a) OVER (PARTITION BY series) AS m FROM vs) WHERE b - a >= 0.5 * m),
ed AS (SELECT series, a, b FROM vl UNION ALL SELECT series, 1, 1 FROM sz UNION ALL SELECT series, n, n FROM sz), st AS (SELECT * FROM (SELECT series, b AS lo, lead(a) OVER (PARTITION BY series ORDER BY a, b) AS hi FROM ed) WHERE hi > lo),
nt AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY lo) - 1 AS nth, row_number() OVER (PARTITION BY series ORDER BY lo) = count(*) OVER (PARTITION BY series) AS final FROM st),
le AS (SELECT nt.*, {_first('nt', 'x.k BETWEEN nt.lo AND nt.hi', 'quantile_cont(height, 0.05)')} AS pile, CASE WHEN final THEN {_first('nt', 'x.k BETWEEN nt.lo AND nt.hi', 'quantile_cont(height, 0.95)')} ELSE {_first('nt', 'x.k = greatest(nt.hi - 1, 1)', 'max(height)')} END AS arrival FROM nt),
up AS (SELECT le.*, CASE WHEN NOT final AND arrival > pile THEN (SELECT max(x.k) FROM sg x JOIN sg y ON y.series = x.series AND y.k = x.k - 1 WHERE x.series = le.series AND x.k > le.lo AND x.k <= le.hi AND y.height < (pile + arrival) / 2 AND x.height >= (pile + arrival) / 2) END AS ups FROM le),
cl AS (SELECT *, CASE WHEN ups IS NULL THEN hi ELSE coalesce({_first('up', 'x.k BETWEEN up.lo AND up.ups AND NOT x.height > pile + 0.1 * (arrival - pile)', 'max(k)')}, lo) END AS climb FROM up),
ca AS (SELECT series, greatest(3 * noise, 0.02 * (max(speed_2d) - min(speed_2d))) AS calm FROM sg JOIN no_speed_2d USING (series) GROUP BY series, noise)
SELECT cl.series, CAST(nth AS INTEGER) AS nth, {_time('lo')} AS a, {_time('hi')} AS b, round(pile, 6) AS pile, round(arrival, 6) AS arrival, {_time('climb')} AS climb, (SELECT min(t) FROM sg x WHERE x.series = cl.series AND x.k BETWEEN lo AND climb AND x.height <= pile + 0.25 * (arrival - pile) AND x.pile_truck_pos < 1 AND x."over" <= 0 AND x.speed_2d <= calm) AS settled FROM cl JOIN ca USING (series)"""


@query("open_readings", _OPEN)
def open_readings(spark, d):
    return phases.open_readings(raw_signals(spark, d)).select("series", "nth", "a", "b", *as_sql("pile", "arrival"), "climb", "settled")


_QUARTER = _signals().replace("CAST(i AS DOUBLE) AS t", "CAST(i * 0.25 AS DOUBLE) AS t")


@query(
    "half_widths",
    f"""{_QUARTER}, {_noise('height')}, sl AS (SELECT series, k, t, CASE WHEN count(*) OVER l >= 3 THEN regr_slope(height, t) OVER l END AS before, CASE WHEN count(*) OVER r >= 3 THEN regr_slope(height, t) OVER r END AS after FROM sg WINDOW l AS (PARTITION BY series ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), r AS (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT series, t, round(least(greatest(CASE WHEN abs(after - before) > 0 THEN noise / abs(after - before) ELSE 1e9 END, 0.75), 1.2), 6) AS half FROM sl JOIN no_height USING (series)""",
)
def half_widths(spark, d):
    return phases.half_widths(raw_signals(spark, d, 0.25), "height").select("series", "t", *r6("half"))


@query(
    "window_starts",
    f"""{_signals()}, wi AS (SELECT series, unnest(range(0, CAST(last AS BIGINT), 8)) AS a FROM sz), ph AS (SELECT series, k, t, 'digging' AS phase, -speed_2d AS v FROM sg UNION ALL SELECT series, k, t, 'hauling', dh_dt FROM sg UNION ALL SELECT series, k, t, 'dumping', -aspect_ratio_dt FROM sg UNION ALL SELECT series, k, t, 'swinging', abs(pile_truck_pos_dt) FROM sg),
inn AS (SELECT wi.series, wi.a, phase, k, t, v, v - lag(v) OVER (PARTITION BY wi.series, wi.a, phase ORDER BY k) AS d FROM wi JOIN ph ON ph.series = wi.series AND t BETWEEN wi.a AND wi.a + 8),
md AS (SELECT series, a, phase, median(d) AS m, count(*) AS n, max(v) AS peak, arg_max(k, v) AS apex, min(k) AS lo FROM inn GROUP BY 1, 2, 3),
nz AS (SELECT md.*, 3 * 1.4826 * (SELECT median(abs(i.d - m)) FROM inn i WHERE i.series = md.series AND i.a = md.a AND i.phase = md.phase AND i.d IS NOT NULL) / sqrt(2.0) AS band FROM md),
ap AS (SELECT nz.*, (SELECT min(k) FROM inn i WHERE i.series = nz.series AND i.a = nz.a AND i.phase = nz.phase AND i.v = peak) AS top FROM nz),
go AS (SELECT ap.*, phase <> 'digging' AND (n < 5 OR band IS NULL OR peak <= band) AS fallback, coalesce((SELECT max(k) + 1 FROM inn i WHERE i.series = ap.series AND i.a = ap.a AND i.phase = ap.phase AND i.k < top AND NOT i.v > band), lo) AS began FROM ap)
SELECT series, phase, CAST(a AS DOUBLE) AS a, CASE WHEN fallback THEN a + 4.0 WHEN phase = 'digging' THEN {_time('top')} ELSE {_time('began')} END AS time, fallback FROM go""",
)
def window_starts(spark, d):
    return phases.window_starts(raw_signals(spark, d), 8.0)
