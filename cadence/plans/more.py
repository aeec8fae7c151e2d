"""Queries of the cue checker, records, seeds, masks and scalars, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import geometry as geo
from cadence.functions import scalars
from cadence.operators import checks, cycles, machine, patterns, search, series, tracks
from cadence.plans.registry import ORACLES, _CORE, _CYCLES, _PIX, _PLACES, SHAPE, W, _trend, big_drops, g, grid, pixels, places, query, r6, runs_sql, starts, trends
from cadence.sources import records
from cadence.sources.tables import load

# ---- cue checks --------------------------------------------------------------------------------

_LABELS = "lb AS (SELECT series, i AS truth, CASE i % 120 WHEN 0 THEN 'digging' WHEN 30 THEN 'hauling' WHEN 60 THEN 'dumping' ELSE 'swinging' END AS phase FROM g WHERE i % 30 = 0), an AS (SELECT series, truth, phase, lag(truth) OVER w AS anchor, last_value(CASE WHEN phase = 'digging' THEN truth END IGNORE NULLS) OVER (PARTITION BY series ORDER BY truth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dig FROM lb WINDOW w AS (PARTITION BY series ORDER BY truth))"


def labels(rows):
    """Every thirtieth sample is an onset; the phases take turns."""
    phase = F.when(F.col("i") % 120 == 0, "digging").when(F.col("i") % 120 == 30, "hauling").when(F.col("i") % 120 == 60, "dumping").otherwise("swinging")
    return rows.where("i % 30 = 0").select("series", F.col("i").alias("truth"), phase.alias("phase"))


@query(
    "first_matches",
    f"{g()}, {_LABELS}, x AS (SELECT an.*, (SELECT min(g.i) FROM g WHERE g.series = an.series AND g.i >= anchor AND g.v > 60) AS a FROM an WHERE phase = 'hauling' AND anchor IS NOT NULL), y AS (SELECT x.*, CASE WHEN a IS NOT NULL THEN coalesce((SELECT min(g.i) - 1 FROM g WHERE g.series = x.series AND g.i > a AND NOT coalesce(g.v > 60, false)), (SELECT max(g.i) FROM g WHERE g.series = x.series)) END AS b FROM x) SELECT series, truth, anchor, a, b, coalesce(truth BETWEEN a - 2 AND b + 2, false) AS contains, a - truth AS start_error, (a + b) / 2 - truth AS centre_error FROM y",
)
def first_matches(spark, d):
    rows = grid(spark, d)
    return checks.first_matches(rows, F.col("v") > 60, labels(rows), "hauling", 2)


_RULED = f"""{_PLACES}, {_LABELS}, sd AS (SELECT series, CASE WHEN coalesce(median(CASE WHEN over_t > 0 THEN x END), 0) >= 0 THEN 1 ELSE -1 END AS side FROM h GROUP BY 1),
l AS (SELECT an.series, truth, anchor, h.i, height, x, y, over_t, side, height > quantile_cont(CASE WHEN h.i >= dig THEN height END, 0.5) OVER w AS high, (x - quantile_cont(CASE WHEN h.i >= dig THEN x END, 0.5) OVER w) * side > 0 AS beside, h.i >= dig AS since FROM an JOIN h USING (series) JOIN sd USING (series) WHERE phase = 'PHASE' AND anchor IS NOT NULL WINDOW w AS (PARTITION BY an.series, truth ORDER BY h.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, coalesce(height > 40, false) AND (ALLOWED) AS ok FROM l WHERE i >= anchor), k2 AS (SELECT *, min(CASE WHEN ok THEN i END) OVER (PARTITION BY series, truth) AS a FROM k),
fm AS (SELECT series, truth, anchor, a, CASE WHEN a IS NOT NULL THEN coalesce(min(CASE WHEN NOT ok AND i > a THEN i END) - 1, max(i)) END AS b, SOFT FROM k2 GROUP BY series, truth, anchor, a) SELECT *, coalesce(truth BETWEEN a - 2 AND b + 2, false) AS contains, a - truth AS start_error, (a + b) / 2 - truth AS centre_error FROM fm"""


def _ruled_sql(phase: str, allowed: str, soft: str) -> str:
    return _RULED.replace("PHASE", phase).replace("ALLOWED", allowed).replace("SOFT", soft)


def _ruled(spark, d, phase):
    rows = places(spark, d)
    wide = rows.join(search.side(rows), "series").select("series", "i", "height", "side", F.col("over").alias("truck_overlap"), *(F.col("x").alias(c) for c in ("bucket_x", "rel_cabin_x")), (F.col("x") - 5).alias("rel_truck_x"), *((F.col("y") - 8).alias(c) for c in ("rel_cabin_y", "rel_truck_y")))
    return checks.first_matches_ruled(wide, F.col("height") > 40, labels(rows), phase, 2)


_SOFT = "coalesce(bool_or(CASE WHEN i = a THEN coalesce({1}, false) END), NULL) AS {0}"


@query("ruled_matches_hauling", _ruled_sql("hauling", "since AND coalesce(high, false)", _SOFT.format("H3", "since AND beside")))
def ruled_matches_hauling(spark, d):
    return _ruled(spark, d, "hauling")


@query("ruled_matches_digging", _ruled_sql("digging", "coalesce(over_t <= 0 AND (x - 5) * side < 0, false)", ", ".join(_SOFT.format(*p) for p in (("D3", "x * side < 0"), ("D4", "y - 8 < 0"), ("D5", "height < 0")))))
def ruled_matches_digging(spark, d):
    return _ruled(spark, d, "digging")


@query("ruled_matches_dumping", _ruled_sql("dumping", "coalesce(x * side > 0, false) AND since AND coalesce(high, false)", ", ".join(_SOFT.format(*p) for p in (("P3", "y - 8 > 0"), ("P4", "height > 0"), ("P5", "y - 8 > 0"), ("P6", "over_t > 0")))))
def ruled_matches_dumping(spark, d):
    return _ruled(spark, d, "dumping")


@query("context_words", f"{g()}, {_trend(12)} SELECT series, i, {SHAPE.format('before')} AS past, {SHAPE.format('after')} AS ahead FROM t")
def context_words(spark, d):
    return trends(spark, d, 12).select("series", "i", patterns.word(F.col("before")).alias("past"), patterns.word(F.col("after")).alias("ahead"))


@query("drop_hits", f"{g()}, dr AS ({ORACLES['big_drops']}) SELECT g.series, g.i, EXISTS (SELECT 1 FROM dr WHERE dr.series = g.series AND dr.onset = g.i) AS hit FROM g")
def drop_hits(spark, d):
    """Every sample, marked where a big drop sets on."""
    return patterns.drop_hits(grid(spark, d), big_drops(spark, d))


_NINE = [f"{a} then {b}" for a in patterns.WORDS for b in patterns.WORDS]
_READ = f"""{_trend(8)}, {_LABELS}, rd AS (SELECT series AS clip, 'level' AS feature, i, {SHAPE.format('before')} || ' then ' || {SHAPE.format('after')} AS shape FROM t UNION ALL SELECT series, 'mirrored', i, {SHAPE.format('(-before)')} || ' then ' || {SHAPE.format('(-after)')} FROM t)"""


@query(
    "shape_search",
    f"""{g()}, {_READ}, nm AS (SELECT unnest({_NINE!r}) AS name), ft AS (SELECT DISTINCT feature FROM rd),
x AS (SELECT an.series, an.truth, an.anchor, feature, name, (SELECT min(r.i) FROM rd r WHERE r.clip = an.series AND r.feature = ft.feature AND r.shape = name AND r.i >= anchor) AS a FROM an, ft, nm WHERE phase = 'dumping' AND anchor IS NOT NULL),
y AS (SELECT x.*, CASE WHEN a IS NOT NULL THEN coalesce((SELECT min(r.i) - 1 FROM rd r WHERE r.clip = x.series AND r.feature = x.feature AND r.i > a AND r.shape IS DISTINCT FROM name), (SELECT max(i) FROM g WHERE g.series = x.series)) END AS b FROM x)
SELECT feature, name AS shape, count_if(coalesce(truth BETWEEN a - 4 AND b + 4, false)) AS contains, count(*) AS n, count_if(coalesce(abs(a - truth) <= 4, false)) AS start_within, count_if(coalesce(abs((a + b) / 2 - truth) <= 4, false)) AS centre_within, CASE WHEN count(a) = count(*) THEN max(abs(a - truth)) END AS worst_start, CASE WHEN count(a) = count(*) THEN max(abs((a + b) / 2 - truth)) END AS worst_centre FROM y GROUP BY 1, 2""",
)
def shape_search(spark, d):
    t = trends(spark, d)
    both = None
    for feature, sign in (("level", 1), ("mirrored", -1)):
        name, _ = patterns.shape()
        one = t.withColumns({"before": F.col("before") * sign, "after": F.col("after") * sign}).select(F.col("series").alias("clip"), F.lit(feature).alias("feature"), "i", name.alias("shape"))
        both = one if both is None else both.union(one)
    return checks.shape_search(both, _NINE, labels(grid(spark, d)), "dumping", 4)


# ---- records -----------------------------------------------------------------------------------

_SAMPLES = "s AS (SELECT CAST(o_custkey % 20 AS BIGINT) AS clip, o_orderkey AS sample FROM orders), m AS (SELECT l_orderkey AS sample, sum(l_quantity) AS area FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS sample, sum(l_quantity) AS area, max(l_tax) AS bucket_confidence FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), c AS (SELECT l_orderkey AS sample, avg(l_discount) AS sam_confidence FROM lineitem WHERE l_linenumber > 2 GROUP BY 1), dt AS (SELECT o_orderkey AS sample, o_totalprice AS detection_score FROM orders WHERE o_orderstatus = 'F')"


@query("build_records", f"WITH {_SAMPLES} SELECT clip, s.sample, m.area IS NOT NULL AS has_mask, round(coalesce(m.area / 5000.0, 0), 6) AS mask_share, round(coalesce(sam_confidence, 0), 6) AS sam_confidence, b.area IS NOT NULL AS has_bucket, round(coalesce(b.area / 5000.0, 0), 6) AS bucket_share, CAST(coalesce(bucket_confidence, 0) AS DOUBLE) AS bucket_confidence, CAST(detection_score AS DOUBLE) AS detection_score FROM s LEFT JOIN m USING (sample) LEFT JOIN c USING (sample) LEFT JOIN b USING (sample) LEFT JOIN dt USING (sample)")
def build_records(spark, d):
    line, orders = load(spark, d, "lineitem"), load(spark, d, "orders")
    samples = orders.select((F.col("o_custkey") % 20).cast("long").alias("clip"), F.col("o_orderkey").alias("sample"))
    per = lambda rows, **aggs: samples.join(rows.groupBy(F.col("l_orderkey").alias("sample")).agg(*(v.alias(n) for n, v in aggs.items())), "sample").select("clip", "sample", *aggs)
    area = F.sum("l_quantity")
    got = machine.build_records(
        samples, per(line.where("l_returnflag = 'R'"), area=area), per(line.where("l_linenumber > 2"), sam_confidence=F.avg("l_discount")),
        per(line.where("l_returnflag = 'A'"), area=area, bucket_confidence=F.max("l_tax")),
        orders.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 20).cast("long").alias("clip"), F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("detection_score")), 5000.0,
    )
    return got.select("clip", "sample", "has_mask", *r6("mask_share", "sam_confidence"), "has_bucket", *r6("bucket_share"), F.col("bucket_confidence").cast("double").alias("bucket_confidence"), F.col("detection_score").cast("double").alias("detection_score"))


@query("truck_pairs", "WITH e AS (SELECT l_orderkey AS sample, max(l_quantity) AS x0, max(l_quantity) + 10 AS x1 FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), t AS (SELECT l_orderkey AS sample, max(l_quantity) AS x0, max(l_quantity) + 10 AS x1 FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), p AS (SELECT sample, greatest(least(e.x1, t.x1) - greatest(e.x0, t.x0), 0) * 10.0 AS common FROM e JOIN t USING (sample)) SELECT sample, round(common / (200.0 - common), 6) AS iou, common / (200.0 - common) <= 0.3 AS clean, common / (200.0 - common) >= 0.3 AS merged FROM p")
def truck_pairs(spark, d):
    def side(flag):
        rows = load(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("sample")).agg(F.max("l_quantity").cast("double").alias("x0"))
        return rows.select("sample", "x0", F.lit(0.0).alias("y0"), (F.col("x0") + 10).alias("x1"), F.lit(10.0).alias("y1"))

    return tracks.pairs(side("N"), side("R"), ["sample"]).select("sample", *r6("iou"), "clean", "merged")


@query("box_spine", f"{_PIX}, b AS (SELECT clip, sample, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE x > 40 GROUP BY 1, 2), s AS (SELECT DISTINCT clip, sample FROM px) SELECT clip, sample, x0, y0, x1, y1 FROM s LEFT JOIN b USING (clip, sample)")
def box_spine(spark, d):
    rows = pixels(spark, d)
    return machine.on_spine(geo.bounding_boxes(rows.where("x > 40")), rows.select("clip", "sample").distinct()).select("clip", "sample", "x0", "y0", "x1", "y1")


@query("half_open_box", f"{_PIX} SELECT clip, sample, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area, round(count(*) / greatest((max(x) + 1 - min(x)) * (max(y) + 1 - min(y)), 1), 6) AS compactness FROM (SELECT DISTINCT * FROM px) GROUP BY 1, 2")
def half_open_box(spark, d):
    return machine.half_open(pixels(spark, d)).withColumn("compactness", F.round("compactness", 6))


@query("mask_algebra", f"{_PIX}, a AS (SELECT DISTINCT * FROM px WHERE x < 30), b AS (SELECT DISTINCT * FROM px WHERE y > 2), u AS (SELECT *, 1 AS a, 0 AS b FROM a UNION ALL SELECT *, 0, 1 FROM b), p AS (SELECT clip, sample, x, y, max(a) AS a, max(b) AS b FROM u GROUP BY ALL) SELECT clip, sample, CAST(sum(a * b) AS BIGINT) AS n_and, count(*) AS n_or, CAST(sum(a * (1 - b)) AS BIGINT) AS n_without FROM p GROUP BY 1, 2")
def mask_algebra(spark, d):
    rows = pixels(spark, d)
    return machine.algebra(rows.where("x < 30"), rows.where("y > 2"))


@query("cabin_pixels", f"{_CORE} SELECT clip, sample, count(*) AS n FROM (SELECT DISTINCT clip, sample, x, y FROM px) JOIN core USING (clip, y, x) GROUP BY 1, 2")
def cabin_pixels(spark, d):
    rows = pixels(spark, d)
    return machine.inside_core(rows, geo.stable_core(rows)).groupBy("clip", "sample").agg(F.count("*").alias("n"))


@query("core_sweep", f"{_PIX}, o AS (SELECT clip, y, x, count(DISTINCT sample) * 1.0 / (SELECT count(DISTINCT sample) FROM px q WHERE q.clip = px.clip) AS occ FROM px GROUP BY clip, y, x), k AS (SELECT clip, q, quantile_cont(occ, q) AS cut FROM o, (SELECT unnest([0.5, 0.7, 0.9]) AS q) GROUP BY 1, 2) SELECT clip, CAST(q AS DOUBLE) AS q, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM o JOIN k USING (clip) WHERE occ >= cut GROUP BY 1, 2".replace("quantile_cont(occ, q)", "CASE q WHEN 0.5 THEN quantile_cont(occ, 0.5) WHEN 0.7 THEN quantile_cont(occ, 0.7) ELSE quantile_cont(occ, 0.9) END"))
def core_sweep(spark, d):
    return machine.core_sweep(pixels(spark, d), (0.5, 0.7, 0.9))


@query("rolling_boxes", f"{_PIX}, b AS (SELECT clip, sample, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE x BETWEEN sample % 20 AND sample % 20 + 9 GROUP BY 1, 2) SELECT clip, sample, CASE WHEN count(*) OVER w = 5 THEN min(x0) OVER w END AS x0, CASE WHEN count(*) OVER w = 5 THEN min(y0) OVER w END AS y0, CASE WHEN count(*) OVER w = 5 THEN max(x1) OVER w END AS x1, CASE WHEN count(*) OVER w = 5 THEN max(y1) OVER w END AS y1 FROM b WINDOW w AS (PARTITION BY clip ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_boxes(spark, d):
    return machine.rolling_boxes(geo.bounding_boxes(pixels(spark, d).where("x between sample % 20 and sample % 20 + 9")), 2)


@query(
    "bucket_quality",
    f"""{_PIX}, m AS (SELECT DISTINCT clip, sample, y, x FROM px WHERE x < 40 AND sample % 7 > 0), b AS (SELECT DISTINCT clip, sample, y, x FROM px WHERE x > 20 AND sample % 4 > 0),
p AS (SELECT b.clip, b.sample, count(*) AS area, count(m.x) AS inner_n, bool_or(b.sample IN (SELECT sample FROM m z WHERE z.clip = b.clip)) AS has FROM b LEFT JOIN m ON m.clip = b.clip AND m.sample = b.sample AND m.y = b.y AND m.x = b.x GROUP BY 1, 2),
q AS (SELECT clip, count(*) AS found, median(CASE WHEN has THEN inner_n / area END) AS containment, quantile_cont(area, 0.9) / quantile_cont(area, 0.1) AS spread, median(area) AS area_median FROM p GROUP BY 1), s AS (SELECT clip, count(DISTINCT sample) AS samples FROM px GROUP BY 1)
SELECT clip, samples, coalesce(found, 0) AS found, round(coalesce(found / samples, 0), 6) AS coverage, round(containment, 6) AS containment, round(spread, 6) AS spread, CAST(area_median AS DOUBLE) AS area_median, concat_ws(',', CASE WHEN coalesce(found / samples, 0) < 0.9 THEN 'coverage' END, CASE WHEN containment < 0.8 THEN 'containment' END, CASE WHEN spread > 4 THEN 'spread' END) AS notes FROM s LEFT JOIN q USING (clip)""",
)
def bucket_quality(spark, d):
    rows = pixels(spark, d)
    out = machine.bucket_quality(rows.where("x < 40 and sample % 7 > 0"), rows.where("x > 20 and sample % 4 > 0"), rows.select("clip", "sample").distinct())
    return out.select("clip", "samples", "found", *r6("coverage", "containment", "spread"), "area_median", "notes")


_SEEDS = f"""{_PIX}, b AS (SELECT DISTINCT clip, sample, y, x FROM px WHERE x BETWEEN sample % 30 AND sample % 30 + 12), t AS (SELECT clip, sample, min(y) AS mask_top FROM px GROUP BY 1, 2),
k AS (SELECT clip, sample, count(*) / greatest((max(x) + 1 - min(x)) * (max(y) + 1 - min(y)), 1) AS compactness, avg(x) AS cx, avg(y) AS band_y, bool_or(x BETWEEN 10 AND 14 AND y BETWEEN 2 AND 3) AS touches FROM b GROUP BY 1, 2),
r AS (SELECT k.*, mask_top, 10.0 + sample % 50 AS reach, row_number() OVER (PARTITION BY clip ORDER BY sample) - 1 AS pos, count(*) OVER (PARTITION BY clip) AS n FROM k LEFT JOIN t USING (clip, sample)),
z AS (SELECT clip, sample, CASE WHEN reach > 0 AND NOT (band_y - mask_top < 1.6) THEN reach / 20.0 + compactness + CASE WHEN cx BETWEEN 10 AND 14 THEN 0 ELSE least(least(abs(cx - 10), abs(cx - 14)) / 10.0, 1) END + 0.5 * (1 - abs(pos - n / 2) / greatest(n / 2, 1)) ELSE 0 END AS score FROM r WHERE NOT touches)"""


def _seeds(spark, d):
    rows = pixels(spark, d)
    reach = rows.select("clip", "sample").distinct().withColumn("reach", 10.0 + F.col("sample") % 50)
    return machine.seed_scores(rows.where("x between sample % 30 and sample % 30 + 12"), rows, reach, (10.0, 2.0, 14.0, 3.0), 20.0)


@query("seed_scores", f"{_SEEDS} SELECT clip, sample, round(score, 6) AS score FROM z")
def seed_scores(spark, d):
    return _seeds(spark, d).select("clip", "sample", *r6("score"))


@query("best_seed", f"{_SEEDS} SELECT clip, arg_min(sample, sample) AS sample, round(max(score), 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY clip) AS top FROM (SELECT clip, sample, round(score, 9) AS score FROM z)) WHERE score = top GROUP BY 1")
def best_seed(spark, d):
    return machine.best_seed(_seeds(spark, d).withColumn("score", F.round("score", 9))).select("clip", "sample", *r6("score"))


@query("reprocessed_spans", f"{g(3600)}, {runs_sql('r', 'g', 'v IS NULL')}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY a) AS n5 FROM r QUALIFY n5 <= 5) SELECT g.series, g.i, CAST(CASE WHEN k.a IS NOT NULL THEN CASE WHEN g.i % 3 > 0 THEN g.i / 2.0 ELSE g.v END ELSE g.v END AS DOUBLE) AS v, k.a IS NOT NULL AS redone FROM g LEFT JOIN k ON k.series = g.series AND g.i BETWEEN k.a AND k.b")
def reprocessed_spans(spark, d):
    rows = grid(spark, d, 3600)
    return machine.reprocessed(rows, patterns.lost_spans(rows, F.col("v").isNull(), 1), rows.where("i % 3 > 0").select("series", "i", (F.col("i") / 2.0).alias("v")))


@query("reseed_counts", f"{g(3600)}, {runs_sql('r', 'g', 'v IS NULL')}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY a) AS n5 FROM r) WHERE n5 <= 5) SELECT g.series, count_if(g.v IS NULL) AS missing_before, count_if(g.v IS NULL AND NOT (k.a IS NOT NULL AND g.i % 3 > 0)) AS missing_after FROM g LEFT JOIN k ON k.series = g.series AND g.i BETWEEN k.a AND k.b GROUP BY 1")
def reseed_counts(spark, d):
    after = reprocessed_spans(spark, d).select("series", "i", F.col("v").alias("after"))
    return grid(spark, d, 3600).join(after, ["series", "i"]).groupBy("series").agg(F.count_if(F.col("v").isNull()).alias("missing_before"), F.count_if(F.col("after").isNull()).alias("missing_after"))


# ---- filters, sets, scalars --------------------------------------------------------------------


@query("confidence_filter", "SELECT o_orderkey, CASE WHEN NOT (o_orderstatus <> 'P' AND coalesce((o_orderkey % 100) / 100.0 < 0.35, false)) THEN CAST(o_totalprice AS DOUBLE) END AS signal FROM orders")
def confidence_filter(spark, d):
    sure = F.col("o_orderkey") % 100 / 100.0
    return load(spark, d, "orders").select("o_orderkey", tracks.confident(F.col("o_totalprice").cast("double"), F.col("o_orderstatus") != "P", sure).alias("signal"))


@query("minmax_panel", f"{g()} SELECT series, i, round(CASE WHEN max(v) OVER p > min(v) OVER p THEN (v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) END, 6) AS scaled FROM g WINDOW p AS (PARTITION BY series)")
def minmax_panel(spark, d):
    return grid(spark, d).select("series", "i", F.round(series.scaled("v"), 6).alias("scaled"))


@query("probe", f"{g(3600)}, k AS (SELECT series, CAST(i AS DOUBLE) AS t, i - lag(i) OVER ({W}) AS d FROM g WHERE v IS NOT NULL), p AS (SELECT series, count(*) AS frames, max(t) - min(t) + median(d) AS duration FROM k GROUP BY 1) SELECT series, frames, CAST(duration AS DOUBLE) AS duration, round(frames / duration, 6) AS fps, CAST(greatest(1, round_even(frames / duration / 0.1, 0)) AS BIGINT) AS stride, round(frames / duration / greatest(1, round_even(frames / duration / 0.1, 0)), 6) AS actual_rate FROM p")
def probe(spark, d):
    return series.probe(grid(spark, d, 3600).where("v is not null").withColumn("t", F.col("i").cast("double")), 0.1).select("series", "frames", "duration", *r6("fps"), "stride", *r6("actual_rate"))


@query("decoupled_rate", f"{g()} SELECT a.series, a.i, a.v, b.v AS detected FROM g a LEFT JOIN g b ON b.series = a.series AND b.i = a.i AND a.i % 10 = 0")
def decoupled_rate(spark, d):
    return series.decoupled(grid(spark, d), "v", 10, "detected")


@query("unknown_keys", "SELECT DISTINCT event_type AS key FROM events EXCEPT SELECT unnest(['view', 'click', 'scroll'])")
def unknown_keys(spark, d):
    return records.unknown_names(load(spark, d, "events").select(F.col("event_type").alias("key")), ["view", "click", "scroll"])


@query("shared_features", "SELECT event_type AS feature FROM events WHERE user_id % 5 = 0 INTERSECT SELECT event_type FROM events WHERE user_id % 7 = 1 INTERSECT SELECT event_type FROM events WHERE value > 90")
def shared_features(spark, d):
    e = load(spark, d, "events")
    pick = lambda c: e.where(c).select(F.col("event_type").alias("feature"))
    return records.shared_names([pick(c) for c in ("user_id % 5 = 0", "user_id % 7 = 1", "value > 90")])


@query("deduped_runs", f"{g()}, {runs_sql('r', 'g', 'v > 50')}, {runs_sql('e', 'g', 'v > 40')} SELECT series, a, max(b) AS b FROM (SELECT series, a, b FROM r UNION ALL SELECT series, a, b FROM e) GROUP BY 1, 2")
def deduped_runs(spark, d):
    rows = grid(spark, d)
    return patterns.one_of_each_start(patterns.runs(rows, F.col("v") > 50), patterns.runs(rows, F.col("v") > 40))


@query("scalar_math", "SELECT o_orderkey, round(1 / (1 + exp(-(o_orderkey % 21 - 10.0))), 6) AS sigmoid, round(degrees(atan2(o_orderkey % 13 - 6.0, o_orderkey % 11 - 5.0)), 6) AS angle, round(sqrt((o_orderkey % 13) ** 2 + (o_orderkey % 11) ** 2), 6) AS reach FROM orders")
def scalar_math(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.round(scalars.sigmoid(k % 21 - 10.0), 6).alias("sigmoid"), F.round(scalars.angle(k % 13 - 6.0, k % 11 - 5.0), 6).alias("angle"), F.round(scalars.reach(k % 13, k % 11), 6).alias("reach"))


@query("prompt_text", "SELECT p_partkey, CASE WHEN lower(trim(p_name)) LIKE '%.' THEN lower(trim(p_name)) ELSE lower(trim(p_name)) || '.' END AS prompt, upper(p_brand) AS shout FROM part")
def prompt_text(spark, d):
    return load(spark, d, "part").select("p_partkey", records.prompt_of(F.col("p_name")).alias("prompt"), F.upper("p_brand").alias("shout"))


@query("sample_clock", "SELECT o_orderkey, round(o_orderkey / 10.0 + ((o_orderkey + 3) / 9.9 - o_orderkey / 9.9), 6) AS clock FROM orders")
def sample_clock(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.round(series.clock(k / 10.0, k / 9.9, (k + 3) / 9.9), 6).alias("clock"))


@query("typed_fields", "WITH j AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 50 END AS n FROM part) SELECT p_partkey, CAST(n AS DOUBLE) AS value, CASE p_partkey % 4 WHEN 1 THEN 'not a number' WHEN 2 THEN 'not a number' WHEN 3 THEN 'not JSON' END AS error FROM j")
def typed_fields(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit('{"a": '), k % 50, F.lit("}"))).when(k % 4 == 1, '{"a": true}').when(k % 4 == 2, '{"a": "7"}').otherwise('{"a": ')
    value, error = cycles.typed_number(raw, "$.a")
    return load(spark, d, "part").select("p_partkey", value.alias("value"), error.alias("error"))


@query("scene_lookup", "SELECT o_orderkey, CAST(s.x AS DOUBLE) AS pivot_x, CAST(s.scale AS DOUBLE) AS scale FROM orders LEFT JOIN (SELECT s_suppkey AS clip, s_suppkey % 17 + 0.5 AS x, s_suppkey % 5 + 1.0 AS scale FROM supplier WHERE s_suppkey % 3 > 0) s ON s.clip = o_custkey % 12")
def scene_lookup(spark, d):
    scene = load(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("clip"), F.to_json(F.struct(F.array((F.col("s_suppkey") % 17 + 0.5).cast("double"), F.lit(0.0)).alias("pivot"), (F.col("s_suppkey") % 5 + 1.0).cast("double").alias("scale"))).alias("scene"))
    return records.with_scene(load(spark, d, "orders").withColumn("clip", F.col("o_custkey") % 12), scene).select("o_orderkey", "pivot_x", "scale")


@query("strict_zip", f"{_CYCLES}, a AS (SELECT clip, time, row_number() OVER (PARTITION BY clip ORDER BY time, phase) AS n FROM s), b AS (SELECT clip, time, row_number() OVER (PARTITION BY clip ORDER BY time, phase) AS n FROM s WHERE phase <> 'dumping'), cn AS (SELECT clip, count(*) AS na, count_if(phase <> 'dumping') AS nb FROM s GROUP BY 1) SELECT a.clip, a.n, round(b.time - a.time, 3) AS apart, NULL AS error FROM a JOIN b USING (clip, n) JOIN cn USING (clip) WHERE na = nb UNION ALL SELECT clip, NULL, NULL, na || ' against ' || nb FROM cn WHERE na <> nb")
def strict_zip(spark, d):
    rows = starts(spark, d)
    return cycles.zipped(rows, rows.where("phase <> 'dumping'")).select("clip", "n", F.round("apart", 3).alias("apart"), "error")


@query("report_lines", "WITH r AS (SELECT o_orderkey AS k, CAST(o_orderkey % 7 AS DOUBLE) AS e, o_orderkey % 7 + (o_orderkey % 5 - 2) * 0.25 AS a FROM orders) SELECT k, printf('%-12s %9.3f %9.3f %+8.3f %s', 'field' || (k % 3), e, CAST(a AS DOUBLE), CAST(a - e AS DOUBLE), CASE WHEN abs(a - e) <= 0.3 THEN 'PASS' ELSE 'FAIL' END) AS line FROM r")
def report_lines(spark, d):
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("field"), k % 3).alias("field"), (k % 7).cast("double").alias("expected"), (k % 7 + (k % 5 - 2) * 0.25).cast("double").alias("actual"))
    return rows.select("k", cycles.report_line(0.3, 12).alias("line"))


@query("banner", f"{_CYCLES}, l AS (SELECT CAST(user_id AS VARCHAR) AS clip, epoch(ts) AS t, event_id FROM events WHERE event_type = 'error'), q AS (SELECT l.clip, l.event_id, l.t, s.phase, s.time FROM l ASOF LEFT JOIN s ON l.clip = s.clip AND l.t + 1e-6 >= s.time) SELECT q.event_id, coalesce(upper(phase), CASE WHEN q.clip IN (SELECT clip FROM s) THEN 'LOOKING FOR DIG START' ELSE 'NO PHASE FOUND' END) AS headline, (SELECT count(*) FROM y WHERE y.clip = q.clip AND y.end_time <= q.t + 1e-6) AS complete FROM q")
def banner(spark, d):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    instants = load(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("clip"), micros.alias("t"), "event_id")
    rows = starts(spark, d)
    return cycles.banner(rows, cycles.assemble(rows), instants).select("event_id", "headline", "complete")
