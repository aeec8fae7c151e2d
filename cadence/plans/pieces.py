"""Queries of spacing, stability, bands, clocks, contexts and checker features, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import geometry as geo
from cadence.operators import checks, cycles, features, intervals, machine, patterns, series
from cadence.plans.more import _LABELS, labels
from cadence.plans.registry import _CORE, _CYCLES, _PIX, SHAPE, as_sql, g, grid, pixels, query, r6, runs_sql, starts
from cadence.sources.tables import load


@query("spacing", f"{g(3600)}, k AS (SELECT series, i - lag(i) OVER (PARTITION BY series ORDER BY i) AS d FROM g WHERE v IS NOT NULL), p AS (SELECT series, median(d) AS m, max(d) - min(d) AS r, count(*) AS n FROM k GROUP BY 1) SELECT series, CASE WHEN n > 1 AND m > 0 THEN CAST(m AS DOUBLE) END AS spacing, CASE WHEN n > 1 AND m > 0 THEN round(r / m, 6) END AS spread, CASE WHEN n > 1 AND m > 0 THEN r / m <= 0.05 END AS uniform, CASE WHEN n < 2 THEN 'fewer than two samples' WHEN m IS NULL OR NOT m > 0 THEN 'times do not increase' END AS error FROM p")
def spacing(spark, d):
    return series.spacing(grid(spark, d, 3600).where("v is not null").withColumn("t", F.col("i").cast("double"))).select("series", "spacing", *r6("spread"), "uniform", "error")


_BOXES = f"{_PIX}, b AS (SELECT clip, sample, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE x BETWEEN sample % 20 AND sample % 20 + 9 GROUP BY 1, 2)"


@query("edge_stability", f"{_BOXES} SELECT clip, sample, " + ", ".join(f"CASE WHEN count(*) OVER w = 5 THEN round(stddev_pop({c}) OVER w, 6) END AS {c}_deviation, CASE WHEN count(*) OVER w = 5 THEN CAST(max({c}) OVER w - min({c}) OVER w AS DOUBLE) END AS {c}_range" for c in ("x0", "y0", "x1", "y1")) + " FROM b WINDOW w AS (PARTITION BY clip ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def edge_stability(spark, d):
    edges = ("x0", "y0", "x1", "y1")
    out = machine.stability(geo.bounding_boxes(pixels(spark, d).where("x between sample % 20 and sample % 20 + 9")), 2)
    return out.select("clip", "sample", *r6(*(f"{c}_deviation" for c in edges)), *(f"{c}_range" for c in edges))


_SPANS = f"{g()}, n AS (SELECT series, i, v FROM g WHERE v > 70)"


@query("near_windows", f"{_SPANS} SELECT series, i, v FROM n WHERE NOT (i > 60 + 5 OR i + 3 < 40 - 5)")
def near_windows(spark, d):
    """Cues within five samples of a required window 40 .. 60."""
    rows = grid(spark, d).where("v > 70").withColumn("b", F.col("i") + 3)
    return rows.where(intervals.near("i", "b", F.lit(40), F.lit(60), 5)).select("series", "i", "v")


@query("widened_events", f"{_SPANS}, e AS (SELECT *, ['fixed', 'span', 'centre'][CAST(i % 3 AS INTEGER) + 1] AS mode FROM n) SELECT series, i, CAST(greatest(CASE mode WHEN 'fixed' THEN i WHEN 'span' THEN i - 0.75 ELSE i + 1 - 1.2 END, 20.0) AS DOUBLE) AS lo, CAST(CASE WHEN i % 2 = 0 THEN least(CASE mode WHEN 'fixed' THEN i + 2 WHEN 'span' THEN i + 2.75 ELSE i + 1 + 1.2 END, i + 2 - 0.001) ELSE CASE mode WHEN 'fixed' THEN i + 2 WHEN 'span' THEN i + 2.75 ELSE i + 1 + 1.2 END END AS DOUBLE) AS hi FROM e")
def widened_events(spark, d):
    rows = grid(spark, d).where("v > 70")
    mode = F.element_at(F.array(F.lit("fixed"), F.lit("span"), F.lit("centre")), (F.col("i") % 3 + 1).cast("int"))
    a = F.col("i").cast("double")
    lo, hi = intervals.widened(mode, a, a + 2, a + 1, F.lit(1.2), F.lit(0.5), F.lit(20.0), F.col("i") % 2 == 0)
    return rows.select("series", "i", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(
    "phase_timers",
    f"""{_CYCLES}, l AS (SELECT CAST(user_id AS VARCHAR) AS clip, epoch(ts) AS t, event_id FROM events WHERE event_type = 'error'), sl AS (SELECT clip, phase, time, lead(time) OVER (PARTITION BY clip ORDER BY time, phase) AS until FROM s),
q AS (SELECT l.clip, l.event_id, l.t, s.phase, s.time FROM l ASOF LEFT JOIN s ON l.clip = s.clip AND l.t + 1e-6 >= s.time) SELECT event_id, phase, round(t - time, 3) AS running_for, """
    + ", ".join(f"round(coalesce((SELECT sum(until - sl.time) FROM sl WHERE sl.clip = q.clip AND sl.phase = '{p}' AND until <= q.t + 1e-6), 0) + CASE WHEN q.phase = '{p}' THEN q.t - q.time ELSE 0 END, 3) AS {p}_total" for p in cycles.PHASES)
    + " FROM q",
)
def phase_timers(spark, d):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    instants = load(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("clip"), micros.alias("t"), "event_id")
    out = cycles.timers(starts(spark, d), instants)
    return out.select("event_id", "phase", F.round("running_for", 3).alias("running_for"), *(F.round(f"{p}_total", 3).alias(f"{p}_total") for p in cycles.PHASES))


def _side(n: int, column: str) -> str:
    rows = f"{n} PRECEDING AND CURRENT ROW" if column == "before" else f"CURRENT ROW AND {n} FOLLOWING"
    w = f"(PARTITION BY series ORDER BY i ROWS BETWEEN {rows})"
    return f"CASE WHEN count(v) OVER {w} = {n + 1} THEN regr_slope(v, CAST(i AS DOUBLE)) OVER {w} * {n} / spread END AS {column}{n}"


_CONTEXT = f"""{g()}, {_LABELS}, sp AS (SELECT series, CASE WHEN quantile_cont(v, 0.95) - quantile_cont(v, 0.05) > 0 THEN quantile_cont(v, 0.95) - quantile_cont(v, 0.05) ELSE 1 END AS spread FROM g GROUP BY 1),
t AS (SELECT series, i, {', '.join(_side(*x) for x in ((12, 'before'), (24, 'before'), (4, 'before'), (4, 'after'), (8, 'before'), (8, 'after')))} FROM g JOIN sp USING (series)),
c AS (SELECT series, i, 12 AS length, {SHAPE.format('before12')} AS word FROM t UNION ALL SELECT series, i, 24, {SHAPE.format('before24')} FROM t),
sh AS (SELECT series, i, 4 AS side, {SHAPE.format('before4')} || ' then ' || {SHAPE.format('after4')} AS shape FROM t UNION ALL SELECT series, i, 8, {SHAPE.format('before8')} || ' then ' || {SHAPE.format('after8')} FROM t),
h AS (SELECT c.series, c.i, length, word, side, shape FROM c JOIN sh ON sh.series = c.series AND sh.i = c.i WHERE word IS NOT NULL AND shape IS NOT NULL),
k AS (SELECT series, truth, anchor, length, word, side, shape FROM an, (SELECT unnest([12, 24]) AS length), (SELECT unnest(['falling', 'flat', 'rising']) AS word), (SELECT unnest([4, 8]) AS side), (SELECT unnest({[f'{a} then {b}' for a in patterns.WORDS for b in patterns.WORDS]!r}) AS shape) WHERE phase = 'dumping' AND anchor IS NOT NULL),
x AS (SELECT k.*, (SELECT min(h.i) FROM h WHERE h.series = k.series AND h.length = k.length AND h.word = k.word AND h.side = k.side AND h.shape = k.shape AND h.i >= anchor) AS a FROM k),
y AS (SELECT x.*, CASE WHEN a IS NOT NULL THEN coalesce((SELECT min(g.i) - 1 FROM g WHERE g.series = x.series AND g.i > a AND NOT EXISTS (SELECT 1 FROM h WHERE h.series = g.series AND h.i = g.i AND h.length = x.length AND h.word = x.word AND h.side = x.side AND h.shape = x.shape)), (SELECT max(i) FROM g WHERE g.series = x.series)) END AS b FROM x)
SELECT series AS clip, 'level' AS feature, CAST(length AS VARCHAR) AS length, word, CAST(side AS VARCHAR) AS side, shape, count_if(coalesce(truth BETWEEN a - 4 AND b + 4, false)) AS contains, count_if(coalesce(abs(a - truth) <= 4, false)) AS timed, count(*) AS n, CASE WHEN count(a) = count(*) THEN max(abs(a - truth)) END AS worst FROM y GROUP BY ALL"""


@query("context_search", _CONTEXT)
def context_search(spark, d):
    rows = series.with_spread(grid(spark, d))
    wide = rows
    for n in (12, 24, 4, 8):
        wide = series.side_changes(wide, "v", n).withColumnsRenamed({"before": f"before{n}", "after": f"after{n}"})
    named = lambda n: F.concat(patterns.word(F.col(f"before{n}")), F.lit(" then "), patterns.word(F.col(f"after{n}")))
    read = wide.select(F.col("series").alias("clip"), F.lit("level").alias("feature"), "i", F.create_map(*(x for n in (12, 24) for x in (F.lit(str(n)), patterns.word(F.col(f"before{n}"))))).alias("words"), F.create_map(*(x for n in (4, 8) for x in (F.lit(str(n)), named(n)))).alias("forms"))
    nine = tuple(f"{a} then {b}" for a in patterns.WORDS for b in patterns.WORDS)
    return checks.context_search(read, labels(grid(spark, d)), "dumping", 4, patterns.WORDS, nine)


_DERIVED = "e AS (SELECT series, i, CAST(v AS DOUBLE) AS v FROM g WHERE v IS NOT NULL)"


@query("checker_sizes", f"{g()}, {_DERIVED} SELECT series, i, CAST(10 + i % 7 AS DOUBLE) AS box_w, CAST(5 + i % 3 AS DOUBLE) AS box_h, CAST((10 + i % 7) * (5 + i % 3) AS DOUBLE) AS box_area, round(sqrt(((v + 5 + (i % 7) / 2.0 - 65) / 10) ** 2 + ((45 - 40 - (5.0 + i % 3) / 2) / 10) ** 2), 6) AS truck_distance, CASE WHEN (40 + 40 + 5 + i % 3) / 2.0 < 45 THEN round(greatest(least(v + 10 + i % 7, 80.0) - greatest(v, 50.0), 0) / (10.0 + i % 7), 6) ELSE 0 END AS truck_overlap FROM e")
def checker_sizes(spark, d):
    """A bucket that drifts over a truck at x 50 .. 80, y 30 .. 60."""
    v, w, h = F.col("v").cast("double"), 10.0 + F.col("i") % 7, 5.0 + F.col("i") % 3
    boxes = grid(spark, d).where("v is not null").select("series", "i", F.col("i").cast("double").alias("t"), v.alias("bx0"), F.lit(40.0).alias("by0"), (v + w).alias("bx1"), (40.0 + h).alias("by1"), F.lit(0.0).alias("cx0"), F.lit(50.0).alias("cy0"), F.lit(20.0).alias("cx1"), F.lit(70.0).alias("cy1"))
    scene = boxes.select("series").distinct().select("series", F.lit(10.0).alias("px"), F.lit(60.0).alias("py"), F.lit(10.0).alias("reach"), F.lit(50.0).alias("tx0"), F.lit(30.0).alias("ty0"), F.lit(80.0).alias("tx1"), F.lit(60.0).alias("ty1"))
    out = features.checker_features(features.assemble(boxes, scene, 4, 1.0), 4, 1.0)
    return out.select("series", "i", *as_sql("box_w", "box_h", "box_area", "truck_distance", "truck_overlap"))


@query("runs_within", f"{g()}, {runs_sql('ru', 'g', 'v > 50')} SELECT ru.series, a, b, n FROM ru JOIN (SELECT series, max(i) // 3 AS lo, max(i) // 2 AS hi FROM g GROUP BY 1) w ON w.series = ru.series WHERE b >= lo AND a <= hi")
def runs_within(spark, d):
    rows = grid(spark, d)
    last = F.max("i")
    return patterns.runs_within(rows, F.col("v") > 50, rows.groupBy("series").agg(F.floor(last / 3).alias("first"), F.floor(last / 2).alias("last")))


_FIELD = "SELECT p_partkey AS clip, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 50 AS DOUBLE) END AS n, CASE p_partkey % 4 WHEN 1 THEN 'not a number' WHEN 2 THEN 'missing' WHEN 3 THEN 'not JSON' END AS e FROM part"


@query("answer_fields_typed", f"WITH f AS ({_FIELD}) SELECT clip, 'cycle_count' AS field, n AS value, e AS error FROM f UNION ALL SELECT clip, name, CASE clip % 4 WHEN 3 THEN NULL ELSE 1.5 END, CASE clip % 4 WHEN 3 THEN 'not JSON' END FROM f, (SELECT unnest({['average_cycle_duration_seconds', *(f'average_phase_duration_seconds.{p}' for p in cycles.PHASES)]!r}) AS name)")
def answer_fields_typed(spark, d):
    k = F.col("p_partkey")
    rest = '"average_cycle_duration_seconds": 1.5, "average_phase_duration_seconds": {' + ", ".join(f'"{p}": 1.5' for p in cycles.PHASES) + "}}"
    count = F.when(k % 4 == 0, F.concat(F.lit('"cycle_count": '), k % 50, F.lit(", "))).when(k % 4 == 1, '"cycle_count": "2", ').otherwise("")
    raw = F.when(k % 4 == 3, "{").otherwise(F.concat(F.lit("{"), count, F.lit(rest)))
    return cycles.typed_fields(load(spark, d, "part").select(k.alias("clip"), raw.alias("answer")))


@query("core_areas", f"{_CORE}, cl AS (SELECT DISTINCT l_returnflag AS clip FROM lineitem UNION SELECT 'none') SELECT cl.clip, count(core.x) AS area FROM cl LEFT JOIN core ON core.clip = cl.clip GROUP BY 1")
def core_areas(spark, d):
    rows = pixels(spark, d)
    clips = rows.select("clip").distinct().union(spark.createDataFrame([("none",)], "clip string"))
    return geo.core_areas(geo.stable_core(rows), clips)
