"""Queries of following objects: two-way tracking, reseeding, endings, splitting, seeds; and peaks by width."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import geometry as geo
from cadence.functions import splitting
from cadence.operators import patterns, reseed, seeding, series
from cadence.plans.registry import _CORE, _DET, _PIX, ORACLES, W, _trend, as_sql, detections, g, grid, pixels, query, r6, runs_sql
from cadence.sources.tables import load
from cadence.streaming import endings, tracking


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# ---- two ways from a seed ----------------------------------------------------------------------

#: From l(series, leg, step, i, v): the blend tracker, with the anchor and the last three outputs.
_FOLD = """r AS (SELECT series, leg, step, i, v AS y, v AS anchor, CAST([] AS DOUBLE[]) AS recent, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM l WHERE step = 0
UNION ALL SELECT series, leg, step, i, y, anchor, recent[-2:] || [y], confidence FROM (SELECT series, leg, step, i, anchor, recent, CASE WHEN v IS NULL THEN base ELSE 0.5 * v + 0.5 * base END AS y, CASE WHEN v IS NULL THEN 0.5 ELSE 1 / (1 + abs(v - base)) END::DOUBLE AS confidence
FROM (SELECT l.*, r.anchor, r.recent, 0.6 * CASE WHEN len(r.recent) > 0 THEN list_sum(r.recent) / len(r.recent) ELSE coalesce(r.anchor, 0) END + 0.4 * coalesce(r.anchor, 0) AS base FROM r JOIN l ON l.series = r.series AND l.leg = r.leg AND l.step = r.step + 1)))"""


@query(
    "two_way_track",
    _recursive(f"""{g()}, sd AS (SELECT series, (min(i) + max(i)) // 3 AS seed FROM g GROUP BY 1),
l AS (SELECT g.series, 'forward' AS leg, i - seed AS step, i, v FROM g JOIN sd ON sd.series = g.series WHERE i >= seed UNION ALL SELECT g.series, 'backward', seed - i, i, v FROM g JOIN sd ON sd.series = g.series WHERE i <= seed),
{_FOLD} SELECT series, i, round(y, 6) AS y, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM r WHERE leg = 'forward' OR step > 0"""),
)
def two_way_track(spark, d):
    rows = grid(spark, d)
    seeds = rows.groupBy("series").agg(F.floor((F.min("i") + F.max("i")) / 3).cast("long").alias("seed"))
    out = tracking.tracked(rows, seeds, tracking.blend("v"), window=4)
    return out.select("series", "i", F.round(F.get("output", F.lit(0)), 6).alias("y"), *r6("confidence"))


# ---- reseeding ---------------------------------------------------------------------------------

_LOST = f"""sm AS (SELECT series, i, v, coalesce(v > 15, false) AS has, v / 100 AS conf, NOT coalesce(v > 15, false) OR coalesce(v / 100 < 0.35, false) AS gone FROM g), {runs_sql('ru', 'sm', 'gone')},
sp AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY a) AS span, a, b FROM ru WHERE b - a + 1 >= 3 QUALIFY span <= 5),
sd AS (SELECT sp.series, span, a, b, arg_max(i, (i * 37 % 11) * 100000 - i) AS seed FROM sp JOIN g ON g.series = sp.series AND g.i BETWEEN a AND b AND g.i % 3 = 0 GROUP BY ALL),
l AS (SELECT g.series, sd.span || ' forward' AS leg, g.i - seed AS step, g.i, v FROM g JOIN sd ON sd.series = g.series AND g.i BETWEEN seed AND b UNION ALL SELECT g.series, sd.span || ' backward', seed - g.i, g.i, v FROM g JOIN sd ON sd.series = g.series AND g.i BETWEEN a AND seed),
{_FOLD}, t AS (SELECT sm.series, sm.i, sd.seed, CASE WHEN sd.seed IS NOT NULL THEN r.y IS NOT NULL ELSE sm.has END AS has_mask, CASE WHEN sd.seed IS NOT NULL THEN coalesce(r.confidence, sm.conf) ELSE sm.conf END AS confidence, r.y, sm.gone, sp.span, sp.a, sp.b
FROM sm LEFT JOIN sp ON sp.series = sm.series AND sm.i BETWEEN sp.a AND sp.b LEFT JOIN sd ON sd.series = sm.series AND sd.span = sp.span LEFT JOIN r ON r.series = sm.series AND r.i = sm.i AND (r.leg LIKE '% forward' OR r.step > 0))"""


def _reseeded(spark, d):
    rows = grid(spark, d)
    samples = rows.select("series", "i", F.col("i").cast("double").alias("t"), F.coalesce(F.col("v") > 15, F.lit(False)).alias("has_mask"), (F.col("v") / 100).alias("confidence"), "v")
    find = reseed.clear_seed((F.col("i") * 37 % 11).cast("double"), F.col("i") % 3 == 0)
    follow = lambda frames, seeds: tracking.tracked(frames, seeds, tracking.blend("v"), window=4, keep_empty=False)
    return reseed.reseeded(samples, find, follow, seconds=3.0)


@query("reseeded_samples", _recursive(f"{g()}, {_LOST} SELECT series, i, has_mask, CAST(round(confidence, 6) AS DOUBLE) AS confidence, round(y, 6) AS y FROM t"))
def reseeded_samples(spark, d):
    out = _reseeded(spark, d)[0]
    return out.withColumn("y", F.get("output", F.lit(0))).select("series", "i", "has_mask", *as_sql("confidence", "y"))


@query("reseed_records", _recursive(f"{g()}, {_LOST} SELECT series, CAST(a AS DOUBLE) AS start_seconds, CAST(b AS DOUBLE) AS end_seconds, count_if(gone) AS missing_before, seed AS seed_sample, CAST(seed AS DOUBLE) AS seed_seconds, CASE WHEN seed IS NOT NULL THEN count_if(NOT has_mask OR coalesce(confidence < 0.35, false)) END AS missing_after FROM t WHERE span IS NOT NULL GROUP BY series, span, a, b, seed"))
def reseed_records(spark, d):
    return _reseeded(spark, d)[1]


# ---- what is open at the end -------------------------------------------------------------------

_PHASE = "CASE WHEN i % 30 = 0 THEN CASE i % 120 WHEN 0 THEN 'digging' WHEN 30 THEN 'hauling' WHEN 60 THEN 'dumping' ELSE 'swinging' END END"


@query(
    "series_endings",
    f"""{g()}, sm AS (SELECT series, i, coalesce(v < 40, true) AS missing, {_PHASE} AS phase FROM g), {runs_sql('ru', 'sm', 'missing')}, e AS (SELECT series, max(i) AS last, arg_max(phase, i) FILTER (phase IS NOT NULL) AS phase FROM sm GROUP BY 1)
SELECT ru.series, 'lost' AS kind, a, b, b = last AS open, NULL AS expected, NULL AS why FROM ru JOIN e ON e.series = ru.series WHERE b - a + 1 >= 2
UNION ALL SELECT series, 'stop', last, last, true, CASE phase WHEN 'digging' THEN 'hauling' WHEN 'hauling' THEN 'dumping' WHEN 'dumping' THEN 'swinging' ELSE 'digging' END, CASE WHEN coalesce(phase, 'swinging') = 'swinging' THEN '{endings.NO_DIG}' ELSE '{endings.NO_STAGE}' END FROM e""",
)
def series_endings(spark, d):
    rows = grid(spark, d)
    phase = F.when(F.col("i") % 30 == 0, F.when(F.col("i") % 120 == 0, "digging").when(F.col("i") % 120 == 30, "hauling").when(F.col("i") % 120 == 60, "dumping").otherwise("swinging"))
    return endings.endings(rows.select("series", "i", F.coalesce(F.col("v") < 40, F.lit(True)).alias("missing"), phase.alias("phase")), 2)


# ---- peaks -------------------------------------------------------------------------------------

_PEAKS = ORACLES["excursions"][: ORACLES["excursions"].index("\nSELECT series, (SELECT max(i)")]


@query(
    "wide_peaks",
    f"""{_PEAKS}, pk AS (SELECT c.*, v - greatest(lb, rb) AS rise, (SELECT max(k) FROM n WHERE n.series = c.series AND n.k > lk AND n.k <= c.k AND n.v = lb) AS lbk, (SELECT min(k) FROM n WHERE n.series = c.series AND n.k < rk AND n.k >= c.k AND n.v = rb) AS rbk FROM c WHERE v - greatest(lb, rb) >= 0.3 * spread),
e AS (SELECT pk.*, v - rise * 0.5 AS level, coalesce((SELECT max(k) FROM n WHERE n.series = pk.series AND n.k BETWEEN lbk AND pk.k AND n.v <= pk.v - rise * 0.5), lbk) AS ak, coalesce((SELECT min(k) FROM n WHERE n.series = pk.series AND n.k BETWEEN pk.k AND rbk AND n.v <= pk.v - rise * 0.5), rbk) AS bk FROM pk),
wd AS (SELECT e.*, ak - 1 + CASE WHEN a0.v < level THEN (level - a0.v) / (a1.v - a0.v) ELSE 0 END AS at_a, bk - 1 - CASE WHEN b0.v < level THEN (level - b0.v) / (b1.v - b0.v) ELSE 0 END AS at_b FROM e JOIN n a0 ON a0.series = e.series AND a0.k = ak JOIN n a1 ON a1.series = e.series AND a1.k = ak + 1 JOIN n b0 ON b0.series = e.series AND b0.k = bk JOIN n b1 ON b1.series = e.series AND b1.k = bk - 1)
SELECT wd.series, wd.i AS top, round(rise, 6) AS prominence, l.i AS left_base, r.i AS right_base, round(at_b - at_a, 6) AS width, round(at_a, 6) AS "left", round(at_b, 6) AS "right" FROM wd JOIN n l ON l.series = wd.series AND l.k = lbk JOIN n r ON r.series = wd.series AND r.k = rbk WHERE at_b - at_a >= 1.2""",
)
def wide_peaks(spark, d):
    out = patterns.wide_peaks(series.with_spread(grid(spark, d)), least=0.3, width=1.2)
    return out.select("series", "top", *r6("prominence"), "left_base", "right_base", *r6("width", "left", "right"))


@query(
    "settle_windows",
    f"""{g()}, {_trend(8)}, n AS (SELECT series, i, -v AS v, spread, after, row_number() OVER ({W}) AS k FROM t WHERE v IS NOT NULL), x AS (SELECT n.*, v - lag(v) OVER w AS l, v - lead(v) OVER w AS r FROM n WINDOW w AS (PARTITION BY series ORDER BY k)),
p AS (SELECT * FROM x WHERE l > 0 AND r > 0),
b AS (SELECT p.*, coalesce((SELECT max(k) FROM n WHERE n.series = p.series AND n.k < p.k AND n.v > p.v), 0) AS lk, coalesce((SELECT min(k) FROM n WHERE n.series = p.series AND n.k > p.k AND n.v > p.v), 1000000) AS rk FROM p),
c AS (SELECT b.*, (SELECT min(v) FROM n WHERE n.series = b.series AND n.k > lk AND n.k <= b.k) AS lb, (SELECT min(v) FROM n WHERE n.series = b.series AND n.k < rk AND n.k >= b.k) AS rb FROM b),
d AS (SELECT series, k, v, (SELECT max(i) FROM x WHERE x.series = c.series AND x.k < c.k AND (x.l IS NULL OR x.l <= 0)) AS context_a, (SELECT min(k) FROM x WHERE x.series = c.series AND x.k > c.k AND (x.r IS NULL OR x.r <= 0)) AS zk FROM c WHERE v - greatest(lb, rb) >= 0.5 * spread),
fl AS (SELECT d.*, z.i AS context_b, coalesce((SELECT min(k) FROM n WHERE n.series = d.series AND n.k >= d.k AND n.v <= z.v + (1 - 0.8) * (d.v - z.v)), (SELECT max(k) FROM n WHERE n.series = d.series)) AS rk FROM d JOIN n z ON z.series = d.series AND z.k = d.zk)
SELECT fl.series, context_a, context_b, w.i AS a, coalesce((SELECT min(i) FROM n WHERE n.series = fl.series AND n.k >= fl.rk AND abs(n.after) < 0.08), (SELECT max(i) FROM n WHERE n.series = fl.series)) AS b FROM fl JOIN n w ON w.series = fl.series AND w.k = fl.rk""",
)
def settle_windows(spark, d):
    return patterns.settle_windows(series.side_changes(series.with_spread(grid(spark, d)), "v", 8))


# ---- masks -------------------------------------------------------------------------------------

#: From q(f, y, x), f a frame: comp(f, y, x, label), the smallest pixel number of each component.
_COMPONENTS = """id AS (SELECT *, row_number() OVER (ORDER BY f, y, x) AS id FROM q), adj AS (SELECT a.id AS p, b.id AS n FROM id a JOIN id b ON a.f = b.f AND a.id <> b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
cc(p, label) USING KEY (p) AS (SELECT id, id FROM id UNION SELECT adj.p, min(cc.label) FROM cc JOIN adj ON adj.n = cc.p JOIN recurring.cc AS o ON o.p = adj.p WHERE cc.label < o.label GROUP BY adj.p),
comp AS (SELECT id.f, y, x, label, count(*) OVER (PARTITION BY id.f, label) / count(*) OVER (PARTITION BY id.f) AS share FROM id JOIN cc ON cc.p = id.id)"""

ORACLES["mask_components"] = _recursive(f"{_PIX}, q AS (SELECT DISTINCT clip || ' ' || sample AS f, clip, sample, y, x FROM px), {_COMPONENTS}, big AS (SELECT *, max(share) OVER (PARTITION BY f) AS top FROM comp) SELECT q.clip, q.sample, q.y, q.x FROM big JOIN q ON q.f = big.f AND q.y = big.y AND q.x = big.x WHERE share >= 0.05 OR top < 0.05")

_ANSWERS = "WITH q AS (SELECT DISTINCT l_returnflag || ' ' || l_suppkey || ' ' || l_linestatus AS f, l_returnflag AS clip, l_suppkey AS sample, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS nth, CAST(l_linenumber AS BIGINT) AS y, CAST(l_quantity AS BIGINT) AS x FROM lineitem WHERE l_discount > 0.04)"


@query("split_objects", _recursive(f"{_ANSWERS}, {_COMPONENTS}, o AS (SELECT q.*, share, CASE WHEN (sample + nth) % 2 = 0 THEN 1 ELSE 2 END AS object, max(share) OVER (PARTITION BY q.f) AS top FROM comp JOIN q ON q.f = comp.f AND q.y = comp.y AND q.x = comp.x) SELECT clip, sample, object, y, x, round(CASE WHEN sample % 10 > 0 THEN 1 / (1 + exp(-(sample % 9 - 4.0 + nth))) END, 6) AS confidence FROM o WHERE share >= CASE object WHEN 1 THEN 0.2 ELSE 0.05 END OR top < CASE object WHEN 1 THEN 0.2 ELSE 0.05 END"))
def split_objects(spark, d):
    """Two objects a frame, whose order turns from one sample to the next."""
    line = load(spark, d, "lineitem").where("l_discount > 0.04")
    px = line.select(F.col("l_returnflag").alias("clip"), F.col("l_suppkey").alias("sample"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("row"), F.struct(F.col("l_linenumber").cast("long").alias("y"), F.col("l_quantity").cast("long").alias("x")).alias("p")).distinct()
    answers = px.groupBy("clip", "sample", "row").agg(F.array_sort(F.collect_list("p")).alias("p"))
    answers = answers.select(
        "clip", "sample", F.when(F.col("sample") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(1))).alias("objects"), "row", F.col("p.y").alias("ys"), F.col("p.x").alias("xs"),
        F.when(F.col("sample") % 10 > 0, F.col("sample") % 9 - 4.0 + F.col("row")).cast("double").alias("logit"),
    )
    return splitting.split_objects(answers, {1: 0.2, 2: 0.05}).select("clip", "sample", "object", "y", "x", *r6("confidence"))


@query("scene", f"{_CORE}, pv AS (SELECT clip, avg(x) AS cx, avg(y) AS cy FROM core GROUP BY 1), tip AS (SELECT px.clip, sample, max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS reach FROM px JOIN pv USING (clip) GROUP BY 1, 2), ar AS (SELECT clip, quantile_cont(reach, 0.95) AS reach FROM tip GROUP BY 1), tk AS ({_DET} SELECT CASE clip % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' END AS clip, median(x0) AS tx0, median(y0) AS ty0, median(x1) AS tx1, median(y1) AS ty1 FROM t WHERE coalesce(iou, 0) <= 0.3 GROUP BY 1) SELECT clip, round(cx, 6) AS px, round(cy, 6) AS py, round(reach, 6) AS reach, CAST(tx0 AS DOUBLE) AS tx0, CAST(ty0 AS DOUBLE) AS ty0, CAST(tx1 AS DOUBLE) AS tx1, CAST(ty1 AS DOUBLE) AS ty1 FROM pv JOIN ar USING (clip) LEFT JOIN tk USING (clip)")
def scene(spark, d):
    trucks = detections(spark, d).withColumn("clip", F.when(F.col("clip") % 3 == 0, "A").when(F.col("clip") % 3 == 1, "R"))
    return seeding.scene(pixels(spark, d), trucks).select("clip", *r6("px", "py", "reach"), "tx0", "ty0", "tx1", "ty1")


#: From q(f, clip, sample, y, x) and st(clip, sy, sx): bfs(f, y, x, d), steps from the pixel nearest to the clip's seed.
_WALK = """s0 AS (SELECT f, y, x FROM q JOIN st USING (clip) QUALIFY row_number() OVER (PARTITION BY f ORDER BY (y - sy) ** 2 + (x - sx) ** 2, y, x) = 1),
bfs(f, y, x, d) USING KEY (f, y, x) AS (SELECT f, y, x, 0 FROM s0 UNION SELECT n.f, n.y, n.x, min(bfs.d + 1) FROM bfs JOIN q n ON n.f = bfs.f AND abs(n.y - bfs.y) <= 1 AND abs(n.x - bfs.x) <= 1 LEFT JOIN recurring.bfs AS o ON o.f = n.f AND o.y = n.y AND o.x = n.x WHERE o.d IS NULL GROUP BY n.f, n.y, n.x),
rc AS (SELECT f, max(d) AS reach FROM bfs GROUP BY 1 HAVING max(d) > 0),
bd AS (SELECT q.clip, q.sample, q.y, q.x, d, reach, CASE WHEN d >= 0.82 * reach THEN 'far' WHEN d >= 0.5 * reach AND d < 0.75 * reach THEN 'middle' END AS band FROM bfs JOIN rc USING (f) JOIN q ON q.f = bfs.f AND q.y = bfs.y AND q.x = bfs.x)"""

ORACLES["geodesic_bands"] = _recursive(f"{_PIX}, q AS (SELECT DISTINCT clip || ' ' || sample AS f, clip, sample, y, x FROM px), st AS (SELECT clip, min(y) AS sy, min(x) AS sx FROM px GROUP BY 1), {_WALK} SELECT clip, sample, y, x, d AS steps, band FROM bd WHERE band IS NOT NULL")

_NEIGHBOURS = "nb AS (SELECT dy, dx, CASE WHEN dy <> 0 AND dx <> 0 THEN 1.3693 ELSE 0.955 END::DOUBLE AS w FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0)"
_FAR = "sqrt((q.y - {0}.y) ** 2 + (q.x - {0}.x) ** 2)"
_PICK = "{0} AS (SELECT q.f, q.clip, q.sample, q.y, q.x FROM dep q {1} QUALIFY row_number() OVER (PARTITION BY q.f ORDER BY {2} DESC, q.y, q.x) = 1)"

ORACLES["interior_points"] = _recursive(f"""{_PIX}, q0 AS (SELECT DISTINCT clip || ' ' || sample AS f, clip, sample, y, x FROM px), q AS (SELECT * FROM q0 QUALIFY count(*) OVER (PARTITION BY f) >= 25), {_NEIGHBOURS},
ed AS (SELECT q.f, q.y, q.x, min(w) AS d FROM q CROSS JOIN nb LEFT JOIN q o ON o.f = q.f AND o.y = q.y + dy AND o.x = q.x + dx WHERE o.f IS NULL GROUP BY 1, 2, 3),
de(f, y, x, d) USING KEY (f, y, x) AS (SELECT f, y, x, d FROM ed UNION SELECT n.f, n.y, n.x, min(de.d + w) FROM de CROSS JOIN nb JOIN q n ON n.f = de.f AND n.y = de.y + dy AND n.x = de.x + dx LEFT JOIN recurring.de AS o ON o.f = n.f AND o.y = n.y AND o.x = n.x WHERE o.d IS NULL OR de.d + w < o.d - 1e-12 GROUP BY 1, 2, 3),
dep AS (SELECT q.*, round(de.d, 9) AS d FROM q JOIN de ON de.f = q.f AND de.y = q.y AND de.x = q.x),
{_PICK.format('p1', '', 'q.d')},
{_PICK.format('p2', 'JOIN p1 ON p1.f = q.f AND (p1.y, p1.x) <> (q.y, q.x)', f"round(q.d * (1 + {_FAR.format('p1')}), 9)")},
{_PICK.format('p3', 'JOIN p1 ON p1.f = q.f AND (p1.y, p1.x) <> (q.y, q.x) JOIN p2 ON p2.f = q.f AND (p2.y, p2.x) <> (q.y, q.x)', f"round(q.d * (1 + least({_FAR.format('p1')}, {_FAR.format('p2')})), 9)")}
SELECT clip, sample, 0 AS nth, y, x FROM p1 UNION ALL SELECT clip, sample, 1, y, x FROM p2 UNION ALL SELECT clip, sample, 2, y, x FROM p3""")

_BASE = "u AS (SELECT clip, quantile_cont(y, 0.2) AS cut FROM core GROUP BY 1), bb AS (SELECT clip, avg(x) AS bx, avg(y) AS b_y FROM core JOIN u USING (clip) WHERE y <= u.cut GROUP BY 1)"
_ARM = f"""{_CORE.replace("quantile_cont(occ, 0.9)", "quantile_cont(occ, 0.99)")}, {_BASE}, q AS (SELECT DISTINCT clip || ' ' || sample AS f, clip, sample, y, x FROM px), st AS (SELECT clip, CAST(round_even(b_y, 0) AS BIGINT) AS sy, CAST(round_even(bx, 0) AS BIGINT) AS sx FROM bb), {_WALK},
dl AS (SELECT DISTINCT clip, y + dy AS y, x + dx AS x FROM core, range(-2, 3) a(dy), range(-2, 3) b(dx)), arm AS (SELECT * FROM bd WHERE band IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dl WHERE dl.clip = bd.clip AND dl.y = bd.y AND dl.x = bd.x))"""


def _arm(spark, d):
    rows = pixels(spark, d)
    core = geo.stable_core(rows, 0.99)
    return seeding.arm_bands(rows, core, geo.boom_base(core))


@query("arm_bands", _recursive(f"{_ARM} SELECT clip, sample, y, x, d AS steps, band, reach FROM arm"))
def arm_bands(spark, d):
    return _arm(spark, d)


_TRUCK = ("R", 3.0, 1.0, 9.0, 4.0)


def _trucks(spark):
    return spark.createDataFrame([_TRUCK], "clip string, tx0 double, ty0 double, tx1 double, ty1 double")


@query(
    "bucket_seeds",
    _recursive(f"""{_ARM}, ctr AS (SELECT clip, avg(x) AS cx, avg(y) AS cy FROM core GROUP BY 1), tip AS (SELECT px.clip, sample, max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS reach FROM px JOIN ctr USING (clip) GROUP BY 1, 2), sc AS (SELECT clip, quantile_cont(reach, 0.95) AS scale FROM tip GROUP BY 1),
sp AS (SELECT clip, min(sample) AS lo, max(sample) AS hi FROM px GROUP BY 1), top AS (SELECT clip, sample, min(y) AS top FROM px GROUP BY 1, 2),
bl AS (SELECT clip, sample, reach, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area, avg(x) AS cx, avg(y) AS band_y FROM arm WHERE band = 'far' GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND NOT bool_or(clip = 'R' AND x BETWEEN 3 AND 9 AND y BETWEEN 1 AND 4)),
z AS (SELECT bl.*, CASE WHEN band_y - top < 0.08 * greatest(scale, 1) THEN 0 ELSE reach / greatest(scale, 1) + area / ((x1 - x0) * (y1 - y0)) + CASE WHEN clip <> 'R' THEN 1 WHEN cx BETWEEN 3 AND 9 THEN 0 ELSE least(least(abs(cx - 3), abs(cx - 9)) / greatest(scale * 0.5, 1), 1) END + 0.5 * (1 - abs(sample - lo - (hi - lo + 1) / 2) / greatest((hi - lo + 1) / 2, 1)) END AS score FROM bl JOIN top USING (clip, sample) JOIN sc USING (clip) JOIN sp USING (clip))
SELECT clip, sample, round(score, 6) AS score, reach, x0, y0, x1, y1 FROM z QUALIFY row_number() OVER (PARTITION BY clip ORDER BY round(score, 9) DESC, sample) = 1"""),
)
def bucket_seeds(spark, d):
    rows = pixels(spark, d)
    out = seeding.bucket_seeds(rows, rows.select("clip", "sample"), _trucks(spark), clear=True, quantile=0.99, least=3)
    return out.select("clip", "sample", *r6("score"), "reach", "x0", "y0", "x1", "y1")


