import numpy as np

from cadence.operators import masks
from cadence.sources import records


def pixels(spark, *shapes):
    rows = [("c", k, int(y), int(x)) for k, m in enumerate(shapes) for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "clip string, sample long, y long, x long")


def test_labels_and_geodesics():
    m = np.zeros((7, 9), bool)
    m[1:6, 1] = m[5, 1:8] = m[1:6, 7] = True  # a U
    m[1, 4] = True
    assert masks.label(m).max() == 2
    d = masks.geodesic(m, 0, 0)
    assert d[1, 1] == 0 and d[1, 7] == 12 and d[1, 4] == -1  # corners are cut
    assert masks.depth(np.ones((5, 5), bool))[2, 2] >= 1
    points = masks.spread_points(np.ones((9, 40), bool), 2)
    assert len(points) == 2 and abs(points[0][1] - points[1][1]) > 10


def test_many_masks_are_walked_at_once(spark):
    rng = np.random.default_rng(5)
    shapes = [rng.random((int(h), int(w))) < share for h, w, share in zip(rng.integers(1, 14, 60), rng.integers(1, 30, 60), rng.uniform(0.2, 1, 60), strict=True)]
    shapes = [m for m in shapes if m.any()] + [np.ones((700, 400), bool)]  # one with more pixels than are walked at a time
    df = pixels(spark, *shapes)
    df = df.union(df.where("sample < 9")).union(spark.createDataFrame([("c", 3, None, 1), ("c", 99, 2, None)], df.schema))  # copies, and pixels without a place
    got = {}
    for r in masks.geodesic_distance(df, spark.createDataFrame([("c", 4, 20)], "clip string, sy long, sx long")).collect():
        assert got.setdefault((r.sample, r.y, r.x), (r.steps, r.reach)) is not None
    far = 0
    for k, m in enumerate(shapes):
        want = masks.geodesic(m, 4, 20)
        assert all(got[k, y, x] == (want[y, x], want.max()) for y, x in np.argwhere(want >= 0).tolist())
        far += int((want >= 0).sum())
    assert len(got) == far
    for few in (True, False):
        part = masks.geodesic_distance(df.where("sample < 20"), spark.createDataFrame([("c", 4, 20)], "clip string, sy long, sx long"), few, 0.82)
        assert {(r.sample, r.y, r.x) for r in part.collect()} == {at for at, (steps, reach) in got.items() if at[0] < 20 and steps >= 0.82 * reach}


def test_small_components_go(spark):
    big, far = np.zeros((40, 60), bool), np.zeros((40, 60), bool)
    big[:20, :20] = True
    far[:20, 40:60] = True
    speck = big.copy()
    speck[30, 50] = True
    got = masks.large_components(pixels(spark, speck, big | far)).groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in got} == {0: 400, 1: 800}


def test_distance_bands_points(spark):
    bar = np.zeros((3, 101), bool)
    bar[1] = True
    px = pixels(spark, bar)
    seeds = spark.createDataFrame([("c", 1, 0)], "clip string, sy long, sx long")
    d = masks.geodesic_distance(px, seeds)
    assert {r.x: r.steps for r in d.collect()} == {x: x for x in range(101)}
    n = {r.band: r["count"] for r in masks.bands(d).groupBy("band").count().collect()}
    assert n == {"far": 19, "middle": 25}
    assert masks.interior_points(px, 3).count() == 3
    boxes = spark.createDataFrame([("c", 0.0, 0.0, 100.0, 100.0)], "clip string, x0 double, y0 double, x1 double, y1 double")
    points = masks.grid_points(boxes).collect()
    assert len(points) == 6 and (round(points[0].py, 6), points[0].px) == (55.0, 15.0) and (round(points[5].py, 6), points[5].px) == (90.0, 85.0)


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"clip": "a", "frames": [{"frame_index": 0, "time_seconds": 0.0, "has_mask": true}, {"frame_index": 3, "time_seconds": 0.1}]}')
    rows = records.read_tracks(spark, str(tmp_path / "a.json")).orderBy("sample").collect()
    assert [(r.clip, r.sample, r.frame_index, r.has_mask, r.bucket_confidence) for r in rows] == [("a", 0, 0, True, None), ("a", 1, 3, None, None)]
    (tmp_path / "l.json").write_text('{"clip": "a", "fps": 30.0, "boundaries": {"digging": 30}}')
    (tmp_path / "m.json").write_text('{"clip": "b", "fps": 10.0, "onsets": [{"phase": "digging", "frame": 16}, {"phase": "hauling", "frame": 23}]}')
    got = {(r.clip, r.phase): r.t for r in records.read_labels(spark, [str(tmp_path / "l.json"), str(tmp_path / "m.json")]).collect()}
    assert got == {("a", "digging"): 1.0, ("b", "digging"): 1.6, ("b", "hauling"): 2.3}
    assert records.config_digest({"a": 1, "b": {"c": 2}}) == records.config_digest({"b": {"c": 2}, "a": 1}) != records.config_digest({"a": 1})
    assert records.merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    bad = spark.createDataFrame([("a", '{"cycle_count":1,"average_cycle_duration_seconds":0.0}'), ("b", "x")], "clip string, answer string")
    assert records.answer_problems(bad).count() == 2
    images = spark.createDataFrame([(b"1",), (b"2",)], "image binary")

    def build():
        return lambda image, prompt: [{"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "score": 0.5, "label": prompt}] if prompt == "truck." or image == b"1" else []

    labels = [r.detections[0].label for r in records.detect(images, build, ["Digger", " truck"]).collect()]
    assert labels == ["digger.", "truck."]
