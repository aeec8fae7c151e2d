"""Two-way tracking, endings, reseeding, splitting, seeds, frame lists and the stage chain."""

import os
import time
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import splitting
from cadence.operators import masks, reseed, seeding
from cadence.plans import following
from cadence.plans.chain import Chain, Stage
from cadence.sources import frame_lists
from cadence.streaming import endings, tracking
from tests.test_masks import pixels

FRAMES = "series string, i long, v double"


def numbered(spark, n=30):
    rows = [("a", i, float(i % 7)) for i in range(n)] + [("b", i, None if i == 3 else float(i)) for i in range(10)]
    return spark.createDataFrame(rows, FRAMES), spark.createDataFrame([("a", 12), ("b", 0)], "series string, seed long")


def stored(df, path, parts):
    """One folder a part, so that a stream takes them one after another."""
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.parquet(f"{path}/in/{k}")
        time.sleep(0.02)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ran(stream, name, path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


# ---- two ways ----------------------------------------------------------------------------------


def test_both_ways_from_the_seed(spark):
    frames, seeds = numbered(spark)

    def follow(frame, memory):
        return [float(frame["i"])], float(len(memory.recent) + (memory.anchor is not None))

    got = {(r.series, r.i): (r.output, r.confidence) for r in tracking.tracked(frames, seeds, follow, window=5).collect()}
    assert len(got) == 40 and all(out == [float(i)] for (_, i), (out, _) in got.items())
    # the seed sees nothing, the next sample the anchor, later ones the anchor and at most four more
    assert [got["a", i][1] for i in (12, 13, 14, 17, 29, 11, 10, 0)] == [0, 1, 2, 5, 5, 1, 2, 5]
    legs = tracking.legs(frames, seeds.withColumn("first", F.lit(0))).where("series = 'b'").select("leg").distinct().collect()
    assert [r.leg for r in legs] == ["forward"]  # a seed on the first sample has no way back


def test_a_limit_keeps_to_the_span(spark):
    frames, _ = numbered(spark, 100)
    seeds = spark.createDataFrame([("a", 60, 50, 72), ("a", 20, 20, 22)], "series string, seed long, first long, last long")
    got = tracking.tracked(frames, seeds, tracking.blend("v")).orderBy("i").collect()
    assert [r.i for r in got] == [20, 21, 22, *range(50, 73)]
    order = {(r.seed, r.leg): [x.i for x in tracking.legs(frames, seeds).where(f"seed = {r.seed} and leg = '{r.leg}'").orderBy("step").collect()] for r in tracking.legs(frames, seeds).select("seed", "leg").distinct().collect()}
    assert order[60, "forward"] == list(range(60, 73)) and order[60, "backward"] == list(range(60, 49, -1))


def test_samples_in_which_nothing_was_found(spark):
    frames, seeds = numbered(spark)
    follow = lambda frame, memory: ([] if frame["i"] % 3 else [1.0], 0.25)
    kept = tracking.tracked(frames, seeds, follow).where("series = 'a'").collect()
    dropped = tracking.tracked(frames, seeds, follow, keep_empty=False).where("series = 'a'").collect()
    assert len(kept) == len(dropped) == 30 and all(r.confidence == 0.25 for r in dropped)
    assert sum(r.output == [] for r in kept) == sum(r.output is None for r in dropped) == 20


def test_stream_equals_batch_with_bounded_state(spark, tmp_path, rocksdb):
    frames, seeds = numbered(spark, 60)
    stream = stored(frames, tmp_path, [F.col("i") % 3 == k for k in (2, 0, 1)])  # out of order
    follow = tracking.blend("v")
    batch = sorted(map(tuple, tracking.tracked(frames, seeds, follow, window=4).collect()))
    assert sorted(map(tuple, ran(tracking.tracked_online(stream, seeds, follow, window=4), "both_ways", tmp_path).collect())) == batch
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state")
    held = {tuple(r["key"]): r["count"] for r in state("recent").groupBy("key").count().collect()}
    assert held == {("a", 12, "forward"): 3, ("a", 12, "backward"): 3, ("b", 0, "forward"): 3}
    anchors = {tuple(r["key"]): list(r["value"]["output"]) for r in state("anchor").collect()}
    assert anchors["a", 12, "forward"] == anchors["a", 12, "backward"] == [5.0]  # never forgotten
    # what is out of reach plays no part: a tracker that reads three outputs back needs no more
    last3 = lambda frame, memory: follow(frame, tracking.Memory(4, memory.anchor, memory.recent[-3:]))
    assert sorted(map(tuple, tracking.tracked(frames, seeds, last3, window=10**9).collect())) == batch
    assert tracking.reach() == 32


# ---- endings -----------------------------------------------------------------------------------


def test_endings_of_a_stream(spark, tmp_path, rocksdb):
    gone = {"a": {3, 4, 5, 9, 27, 28, 29}, "b": {0, 1}, "c": set()}
    length = {"a": 30, "b": 5, "c": 90}
    phases = {"a": {0: "digging", 8: "hauling"}, "b": {2: "swinging"}, "c": {}}
    rows = [(s, i, i in gone[s], phases[s].get(i)) for s in gone for i in range(length[s])]
    df = spark.createDataFrame(rows, "series string, i long, missing boolean, phase string")
    want = {tuple(r) for r in endings.endings(df, 2).collect()}
    assert ("a", "lost", 27, 29, True, None, None) in want and ("a", "lost", 3, 5, False, None, None) in want
    assert ("a", "stop", 29, 29, True, "dumping", endings.NO_STAGE) in want and ("c", "stop", 89, 89, True, "digging", endings.NO_DIG) in want
    timed = df.select("series", F.timestamp_seconds(F.col("i") + 1000).alias("t"), "missing", "phase")  # 0 would be late at once
    # one row that belongs to no series ends the input
    end = spark.createDataFrame([(None, datetime(1970, 1, 1, 1, tzinfo=timezone.utc), False, None)], timed.schema)
    both = timed.union(end).withColumn("n", F.unix_timestamp("t") - 1000)
    parts = [(F.col("n") < 20) & (F.col("n") % 2 == 1), (F.col("n") < 20) & (F.col("n") % 2 == 0), F.col("n").between(20, 999), F.col("n") > 999]
    stream = stored(both, tmp_path, parts).drop("n")
    got = ran(endings.endings_online(stream, 2, patience=10, delay="25 seconds"), "ends", tmp_path)
    seconds = got.select("series", "kind", (F.unix_timestamp("a") - 1000).alias("a"), (F.unix_timestamp("b") - 1000).alias("b"), "open", "expected", "why")
    assert {tuple(r) for r in seconds.collect()} == want


# ---- reseeding ---------------------------------------------------------------------------------

SAMPLES = "series string, i long, t double, has_mask boolean, confidence double"


def track(spark, n, lost=()):
    return spark.createDataFrame([("s", i, i / 10, i not in lost, 0.08 if i in lost else 0.95) for i in range(n)], SAMPLES)


def found_everywhere(calls):
    def follow(frames, seeds):
        calls.append(sorted(map(tuple, seeds.select("seed", "first", "last").collect())))
        return frames.join(seeds, "series").where("i between first and last").select("series", "i", F.array(F.lit(1.0)).alias("output"), F.lit(0.9).alias("confidence"))

    return follow


def at(*seeds):
    return lambda rows: rows.where(F.col("i").isin(*seeds)).select("series", "span", F.col("i").alias("seed"))


def test_what_is_lost(spark):
    audit = spark.createDataFrame([("s", 0, 0.0, True, 0.9), ("s", 1, 0.1, False, None), ("s", 2, 0.2, True, 0.2), ("s", 3, 0.3, True, float("nan"))], SAMPLES)
    assert [(r.a, r.b) for r in reseed.lost(audit, seconds=0.2).collect()] == [(1, 2)]
    spans = lambda n, lost: [(r.a, r.b) for r in reseed.lost(track(spark, n, lost)).orderBy("a").collect()]
    assert spans(40, range(10, 19)) == []  # nine samples are 0.9 s
    assert spans(40, range(10, 20)) == [(10, 19)]
    assert spans(50, range(35, 50)) == [(35, 49)]  # to the end


def test_a_span_is_reseeded_inside_and_only_there(spark):
    calls = []
    rows, records = reseed.reseeded(track(spark, 50, range(30, 50)), at(40), found_everywhere(calls))
    assert [tuple(r)[1:] for r in records.collect()] == [(3.0, 4.9, 20, 40, 4.0, 0)]
    assert calls == [[(40, 30, 49)]] and rows.where("not has_mask or confidence < 0.35").count() == 0
    # a tracker that tells of other samples too
    wide = lambda frames, seeds: spark.range(50).select(F.lit("s").alias("series"), F.col("id").alias("i"), F.array(F.lit(1.0)).alias("output"), F.lit(0.5).alias("confidence"))
    rows, _ = reseed.reseeded(track(spark, 50, range(20, 32)), at(25), wide)
    assert {r.i: r.confidence for r in rows.collect()} == {i: 0.5 if 20 <= i <= 31 else 0.95 for i in range(50)}


def test_spans_without_a_seed_or_that_stay_lost(spark):
    nothing = reseed.clear_seed(F.col("t"), F.lit(False))
    rows, records = reseed.reseeded(track(spark, 50, range(30, 50)), nothing, found_everywhere([]))
    assert [tuple(r)[1:] for r in records.collect()] == [(3.0, 4.9, 20, None, None, None)] and rows.where("confidence < 0.35").count() == 20
    buried = lambda frames, seeds: frames.select("series", "i", F.array().cast("array<double>").alias("output"), F.lit(0.05).alias("confidence"))
    _, records = reseed.reseeded(track(spark, 50, range(30, 50)), at(40), buried)
    assert [r.missing_after for r in records.collect()] == [20]
    many = {i for start in range(0, 200, 20) for i in range(start, start + 12)}
    assert reseed.reseeded(track(spark, 200, many), nothing, found_everywhere([]), most=3)[1].count() == 3
    assert reseed.reseeded(track(spark, 50), at(0), found_everywhere([]))[1].count() == 0
    calls = []
    reseed.reseeded(track(spark, 80, {*range(10, 25), *range(50, 70)}), at(12, 52), found_everywhere(calls))[1].collect()
    assert calls == [[(12, 10, 24), (52, 50, 69)]]


# ---- splitting ---------------------------------------------------------------------------------


def blob(y, x, r, shape=(60, 90)):
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    return np.hypot(ys - y, xs - x) <= r


def answers(spark, objects, shapes, logits):
    rows = [("c", 0, objects, k, *(a.tolist() for a in np.nonzero(m)), z) for k, (m, z) in enumerate(zip(shapes, logits, strict=True))]
    return spark.createDataFrame(rows, "clip string, sample long, objects array<int>, row int, ys array<long>, xs array<long>, logit double")


def test_objects_by_reported_id_with_their_own_cut(spark):
    big, small = blob(30, 30, 20), blob(20, 70, 8)
    got = splitting.split_objects(answers(spark, [2, 1], [small, big], [0.0, -4.0]), {1: 0.05, 2: 0.01})
    told = {r.object: (r["count"], r.confidence) for r in got.groupBy("object", "confidence").count().collect()}
    assert told[1][0] == big.sum() and told[2] == (small.sum(), 0.5) and abs(told[1][1] - 0.0179) < 1e-3
    speck = small.copy()
    speck[50:52, 2:5] = True
    got = splitting.split_objects(answers(spark, [1, 2], [speck, speck], [None, 1.0]), {1: 0.05, 2: 0.01})
    there = {r.object for r in got.where("y = 50 and x = 3").collect()}
    assert there == {2} and got.where("object = 1 and confidence is not null").count() == 0
    splitting.register(spark)
    answers(spark, [1], [big], [0.0]).createOrReplaceTempView("told")
    assert spark.sql("SELECT * FROM split_objects(TABLE(told), map(1, 0.05D))").collect()[0].object == 1
    with pytest.raises(Exception, match="lacks logit"):
        splitting.split_objects(answers(spark, [1], [big], [0.0]).drop("logit"), {1: 0.1}).collect()


# ---- seeds -------------------------------------------------------------------------------------

SHAPE, PIVOT = (240, 320), (60.0, 180.0)


def machine(elbow=(150, 90), bucket=(240, 150)):
    ys, xs = np.mgrid[: SHAPE[0], : SHAPE[1]]
    body = np.hypot(xs - PIVOT[0], ys - PIVOT[1]) <= 34
    mask = body.copy()
    for (x0, y0), (x1, y1) in ((PIVOT, elbow), (elbow, bucket)):
        for t in np.linspace(0, 1, 200):
            mask |= np.hypot(xs - x0 - t * (x1 - x0), ys - y0 - t * (y1 - y0)) <= 7
    return mask | (np.hypot(xs - bucket[0], ys - bucket[1]) <= 18), body


#: An arm that moves, so that only the body stays where it is.
ARMS = [((110, 100), (170, 110)), ((135, 75), (215, 95)), ((150, 90), (240, 150)), ((150, 150), (250, 190)), ((125, 190), (205, 215)), ((90, 80), (130, 60))]


def seeded(spark, shapes, truck=None, **how):
    rows = pixels(spark, *shapes)
    trucks = spark.createDataFrame([("c", *truck)] if truck else [], "clip string, tx0 double, ty0 double, tx1 double, ty1 double")
    samples = spark.range(len(shapes)).select(F.lit("c").alias("clip"), F.col("id").alias("sample"))
    return seeding.bucket_seeds(rows, samples, trucks, **how)


def test_the_best_frame_with_its_points(spark):
    shapes = [machine(*arm)[0] for arm in ARMS]
    (seed,) = seeded(spark, shapes, points=4, negatives=2).collect()
    assert len(seed.points) == 4 and len(seed.negatives) == 2 and 0 <= seed.sample < 6
    assert all(seed.x0 <= x < seed.x1 and seed.y0 <= y < seed.y1 for x, y in seed.points)
    bx, by = ARMS[seed.sample][1]
    assert seed.x0 <= bx < seed.x1 and seed.y0 <= by < seed.y1  # the box is on the bucket
    assert all(np.hypot(x - bx, y - by) > 18 for x, y in seed.negatives)
    # inside a span, only its frames compete
    spans = spark.createDataFrame([("c", 7, 0, 1)], "clip string, span long, first long, last long")
    assert [(r.span, r.sample <= 1) for r in seeded(spark, shapes, spans=spans).collect()] == [(7, True)]
    assert seeded(spark, [np.zeros(SHAPE, bool)]).collect() == []


def test_every_frame_is_walked_once(spark):
    plan = following.bucket_seeds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(node) for node in ("MapInArrow", "FlatMapGroupsInPandas", "MapInPandas")) == 1


def test_over_the_truck_is_no_place_to_seed(spark):
    truck = (230.0, 100.0, 310.0, 200.0)
    over = [machine(elbow, (270, 130 + 10 * k))[0] for k, elbow in enumerate(((110, 100), (135, 75), (150, 150), (125, 190)))]
    clear = machine((110, 110), (170, 190))[0]
    assert [r.sample for r in seeded(spark, [*over[:2], clear, *over[2:]], truck, clear=True).collect()] == [2]
    assert seeded(spark, over, truck, clear=True).collect() == []
    assert len(seeded(spark, over, truck).collect()) == 1  # a penalty only


def test_the_body_is_off_the_bands(spark):
    mask, body = machine()
    core = pixels(spark, body).select("clip", "y", "x")
    base = spark.createDataFrame([("c", PIVOT[0], PIVOT[1])], "clip string, bx double, by double")
    bands = seeding.arm_bands(pixels(spark, mask), core, base).collect()
    near = [r for r in bands if np.hypot(r.x - PIVOT[0], r.y - PIVOT[1]) <= 35]
    assert bands and not near and {r.band for r in bands} == {"far", "middle"}
    assert seeding.dilated(core).count() > core.count()


def test_points_against_a_plain_version():
    rng = np.random.default_rng(3)
    mask = rng.random((14, 17)) < 0.8
    inner = np.pad(mask, 1)
    deep = np.where(inner, np.inf, 0.0)
    while True:  # shortest way to a pixel outside, step by step
        new = deep.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    new = np.minimum(new, np.roll(deep, (dy, dx), (0, 1)) + (masks.ACROSS if dy and dx else masks.STRAIGHT))
        new = np.where(inner, new, 0.0)
        if np.allclose(new, deep, equal_nan=True, atol=1e-12):
            break
        deep = new
    assert np.allclose(masks.depth(mask), deep[1:-1, 1:-1], atol=1e-8)
    left = {(int(y), int(x)): round(float(deep[y + 1, x + 1]), 9) for y, x in zip(*np.nonzero(mask), strict=True)}
    want = []
    for _ in range(4):
        merit = lambda p: left[p] * (1 + min(np.hypot(p[0] - y, p[1] - x) for y, x in want)) if want else left[p]
        best = max(left, key=lambda p: (round(merit(p), 9), -p[0], -p[1]))
        want.append(best)
        del left[best]
    assert masks.spread_points(mask, 4) == want
    assert masks.spread_points(np.ones((4, 6), bool), 3) == []  # too small to trust


def test_prompts(spark):
    seeds = seeded(spark, [machine(*arm)[0] for arm in ARMS], points=3, negatives=2).withColumn("sample", F.lit(0).cast("long"))
    bands = spark.createDataFrame([("c", 0, 5, 6, "far"), ("c", 0, 9, 9, "middle")], "clip string, sample long, y long, x long, band string")
    prompt = lambda form: seeding.prompts(seeds, bands, form).collect()[0].prompt
    assert prompt("points").labels == [1, 1, 1, 0, 0] and len(prompt("points").points) == 5
    assert len(prompt("box").box) == 4 and prompt("mask").pixels == [[5, 6]]
    with pytest.raises(ValueError, match="not 'line'"):
        prompt("line")


# ---- frame lists -------------------------------------------------------------------------------


def clip(folder, name, times, broken=False):
    os.makedirs(folder / name)
    lines = ["# time file"]
    for k, t in enumerate(times):
        lines.append(f"{t} {k}.png" if not (broken and k == 1) else f"{k}.png")
        (folder / name / f"{k}.png").write_bytes(f"{name}{k}".encode())
    (folder / name / "frames.txt").write_text("\n".join(lines))


def test_frames_are_read_only_if_asked_for(spark, tmp_path):
    clip(tmp_path, "a", [5.0, 5.5, 6.25, 7.0])
    clip(tmp_path, "b", [0.0, 0.1])
    got = {(r.clip, r.frame_index): (r.time_seconds, bytes(r.image)) for r in frame_lists.frames(spark, str(tmp_path)).collect()}
    assert got["a", 2] == (1.25, b"a2") and len(got) == 6
    for k in range(4):  # without the images, what needs none of them still runs
        (tmp_path / "a" / f"{k}.png").unlink()
    times = frame_lists.frame_times(spark, str(tmp_path))
    assert [r.time_seconds for r in times.where("clip = 'a'").orderBy("frame_index").collect()] == [0.0, 0.5, 1.25, 2.0]
    images = frame_lists.frames(spark, str(tmp_path))
    assert images.where("clip = 'b' and time_seconds > 0.05").select("image").collect()[0].image == b"b1"  # a's images are not opened
    plan = images.where("time_seconds > 0.05")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter(" not in plan
    assert [r.frame_index for r in frame_lists.frames(spark, str(tmp_path), stride=3, schema="clip string, frame_index long").where("clip = 'a'").collect()] == [0, 3]
    assert frame_lists.frames(spark, str(tmp_path)).where("clip = 'none'").collect() == []


def test_a_frame_without_a_time_is_an_error(spark, tmp_path):
    clip(tmp_path, "a", [0.0, 0.1], broken=True)
    with pytest.raises(Exception, match="no timestamp"):
        frame_lists.frame_times(spark, str(tmp_path)).collect()


def test_a_stream_of_clips(spark, tmp_path):
    clip(tmp_path / "in", "a", [0.0, 0.5])
    stream = frame_lists.frame_stream(spark, str(tmp_path / "in"), schema="clip string, frame_index long, time_seconds double")
    q = stream.writeStream.format("memory").queryName("clips").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        assert spark.table("clips").count() == 2
        time.sleep(0.05)
        clip(tmp_path / "in", "b", [0.0, 0.1, 0.2])
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.clip, r["count"]) for r in spark.table("clips").groupBy("clip").count().collect()} == {("a", 2), ("b", 3)}


# ---- the chain ---------------------------------------------------------------------------------


def doubled(source, times=2):
    return source.select((F.col("x") * times).alias("x"))


def summed(rows, plus=0):
    return rows.agg((F.sum("x") + plus).alias("x"))


def test_only_what_is_out_of_date_runs(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "made")
    spark.range(5).select(F.col("id").alias("x")).write.parquet(source)
    noted = lambda rows: ["few rows"]

    def chain(times=2, plus=0, run=summed):
        return Chain(spark, folder, {"numbers": source}, [Stage("double", doubled, ["numbers"], {"times": times}, noted), Stage("sum", run, ["double"], {"plus": plus}), Stage("again", doubled, ["sum"])])

    said = lambda told: [t.status for t in told]
    first = chain().run()
    assert said(first) == ["ran"] * 3 and first[0].concerns == ["few rows"] and chain().table("again").collect()[0].x == 40
    before = sorted(os.listdir(folder))
    assert said(chain().run()) == ["reused"] * 3 and sorted(os.listdir(folder)) == before
    assert said(chain(plus=1).run()) == ["reused", "ran", "ran"] and chain(plus=1).table("again").collect()[0].x == 42
    assert said(chain().run(again=["sum"])) == ["reused", "ran", "ran"]

    def broken(rows, plus=0):
        raise RuntimeError("no memory")

    failed = chain(times=3, run=broken).run()
    assert said(failed) == ["ran", "failed", "not run"] and failed[1].error == "RuntimeError: no memory"
    assert said(chain(times=3).run()) == ["reused", "ran", "ran"]  # goes on from there
    spark.range(6).select(F.col("id").alias("x")).write.mode("overwrite").parquet(source)
    assert said(chain().run()) == ["ran"] * 3
    with pytest.raises(ValueError, match="needs nothing before it"):
        Chain(spark, folder, {}, [Stage("a", doubled, ["nothing"])])


def scored(spark, bands, masks_, truck=None, scale=120.0, clear=False):
    """Scores of frames whose bucket band and whole mask are given as (y, x) boxes."""
    cells = lambda boxes: [("c", k, y, x) for k, (y0, x0, y1, x1) in boxes for y in range(y0, y1) for x in range(x0, x1)]
    schema = "clip string, sample long, y long, x long"
    band = spark.createDataFrame(cells(bands), schema).withColumn("band", F.lit("far")).withColumn("reach", F.lit(100))
    trucks = spark.createDataFrame([("c", *truck)] if truck else [], "clip string, tx0 double, ty0 double, tx1 double, ty1 double")
    spans = spark.createDataFrame([("c", 0, 0, 99)], "clip string, span long, first long, last long")
    scales = spark.createDataFrame([("c", scale)], "clip string, arm_reach double")
    return {r.sample: r.score for r in seeding.frame_scores(band, spark.createDataFrame(cells(masks_), schema), scales, spans, trucks, clear).collect()}


def test_what_makes_a_frame_good(spark):
    body = (40, 0, 60, 30)
    blob_ = (50, 100, 58, 108)
    got = scored(spark, [(50, blob_), (99, blob_)], [(k, (10, 0, 60, 120)) for k in (50, 99)])
    assert got[50] > got[99]  # the middle of the clip, as a tracker runs both ways
    smear = (50, 40, 52, 72)  # as many pixels in a long strip with a corner
    got = scored(spark, [(50, blob_), (49, smear), (49, (52, 40, 60, 41))], [(k, (10, 0, 60, 120)) for k in (49, 50)])
    assert got[50] > got[49]
    truck = (80.0, 20.0, 99.0, 70.0)
    got = scored(spark, [(50, blob_), (51, (50, 200, 58, 208))], [(k, (10, 0, 60, 220)) for k in (50, 51)], truck)
    assert got[51] > got[50]  # further from the truck
    # a band on the top of the machine is the boom, one below it is not
    got = scored(spark, [(50, (10, 140, 20, 165)), (51, (30, 140, 40, 165))], [(k, (10, 0, 60, 170)) for k in (50, 51)])
    assert got[50] == 0 and got[51] > 0
    split = [(50, (55, 60, 63, 68)), (50, (30, 90, 34, 94))]  # one piece clear of the truck, one inside its box
    assert 50 in scored(spark, split, [(50, (10, *body[1:]))], truck) and scored(spark, split, [(50, (10, *body[1:]))], truck, clear=True) == {}
    assert scored(spark, [(50, (50, 100, 54, 106))], [(50, body)]) == {}  # 24 pixels are too few
