"""Bucketed joins, searches and windows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import assign, boxes, features, graph, roi

BOX = "idx long, x_min double, x_max double, y_min double, y_max double"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(size=(300, 2)) * 10, rng.normal(size=(200, 2)) * 0.1, [[0, 0], [0, 0], [1e6, -1e6]]])
    low = rng.normal(size=(60, 2)) * 8
    side = 10.0 ** rng.uniform(-3, 2, (60, 2)) * rng.integers(0, 2, (60, 1))
    rects = [(i, *map(float, (a[0], a[0] + s[0], a[1], a[1] + s[1]))) for i, (a, s) in enumerate(zip(low, side, strict=True))] + [(60, -1e7, 1e7, -1e7, 1e7), (61, 0.0, 0.0, 0.0, 0.0), (62, 5.0, 4.0, 0.0, 1.0), (63, None, 1.0, 0.0, 1.0)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(900, None, 1.0)], "row_id long, x double, y double")
    return xy, rects, points, spark.createDataFrame(rects, BOX)


def test_points_in_boxes(data):
    xy, rects, points, df = data
    want = {(r[0], i) for r in rects if r[1] is not None for i, (x, y) in enumerate(xy) if r[1] <= x <= r[2] and r[3] <= y <= r[4]}
    got = [(r.idx, r.row_id) for r in roi.crop_each(points, df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.row_id for r in roi.crop_union(points, df).collect()} == {i for _, i in want}
    assert roi.crop_each(points, df.limit(0)).count() == 0


def test_touching_boxes_and_regions(spark, data):
    _, rects, _, df = data
    whole = [r for r in rects if r[1] is not None and r[1] <= r[2] and r[0] != 60]
    want = {(a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]}
    small = df.where("idx <> 60")
    assert sorted((r.idx, r.b_idx) for r in boxes.touching_boxes(small).collect()) == sorted(want)
    assert {(r.i, r.j) for r in roi.overlaps(df).collect()} == want | {(r[0], 60) for r in whole if r[0] < 60} | {(60, 61)}
    chain = spark.createDataFrame([(i * 37 % 150, float(i), i + 1.0, 0.0, 1.0) for i in range(150)], BOX)
    assert {r.region for r in roi.support(chain).collect()} == {0}
    with pytest.raises(RuntimeError, match="settled"):
        roi.support(chain, rounds=2)


def test_unsettled_groups_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "i long, j long")
    values = spark.range(201).select(F.col("id").alias("cell"), F.lit(1.0).alias("value"))
    assert {r.group for r in graph.sign_groups(edges, values).collect()} == {0}
    with pytest.raises(RuntimeError, match="settled"):
        graph.sign_groups(edges, values, rounds=2)


@pytest.mark.parametrize("least", [1, 7, 60, 10_000])
def test_knn_points(spark, data, least):
    xy, _, points, _ = data
    centres = [(0, 0.0, 0.0), (1, 500.0, 500.0), (2, -3.0, 4.0), (3, 1e7, 0.0)]
    cells = spark.createDataFrame(centres, "cell int, c_x double, c_y double")
    assigned = points.where("row_id < 5").withColumn("cell", F.lit(2))
    got = {(r.cell, r.row_id) for r in assign.knn_points(assigned, points, cells, least).collect()}
    want = {(2, i) for i in range(5)} if least <= 5 else set()
    for c, x, y in centres:
        if c != 2 or least > 5:
            d = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
            want |= {(c, int(i)) for i in sorted(range(len(xy)), key=lambda i: (d[i], i))[:least]}
    assert got == want


def test_caps_and_bounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), float(rng.integers(20))) for i in range(800)]
    df = spark.createDataFrame(rows, "row_id long, cell int, distance double")
    nearest = lambda c, k, far=1e9: sorted((r for r in rows if r[1] == c and r[2] <= far), key=lambda r: (r[2], r[0]))[:k]
    assert sorted(tuple(r) for r in assign.cap_points(df, 9).collect()) == sorted(r for c in range(4) for r in nearest(c, 9))
    limits = spark.createDataFrame([(0, None, 5, None), (1, 10_000, None, None), (2, 3, None, 7.0)], "cell int, least int, most int, radius double")
    want = nearest(0, 5) + nearest(2, 10_000, 7.0) + nearest(3, 10_000)
    assert sorted(tuple(r) for r in assign.bounded_by(df, limits).select(*df.columns).collect()) == sorted(want)


def test_time_searches(spark):
    rng = np.random.default_rng(7)
    t = np.concatenate([rng.random(300) * 5, 1000 + rng.random(20), [1e6]])
    df = spark.createDataFrame([(i, float(x), "ab"[i % 2]) for i, x in enumerate(t)] + [(900, None, "a")], "row_id long, t double, source string")
    segs = [(0, 0.0, 1.0), (1, 400.0, 600.0), (2, -5.0, -4.0), (3, 999.0, 1002.0), (4, 2e6, 2e6)]
    for k in (1, 12, 400):
        want = {(s, int(i), r + 1) for s, a, b in segs for r, i in enumerate(sorted(range(len(t)), key=lambda i: (abs(t[i] - (a + b) / 2), i))[:k])}
        assert {tuple(r) for r in assign.time_knn(df, segs, k).collect()} == want
    spans = spark.createDataFrame(segs, "seg int, t0 double, t1 double")
    assert {(r.row_id, r.seg) for r in assign.in_segments(df, spans).collect()} == {(i, s) for s, a, b in segs for i in range(len(t)) if a <= t[i] < b}
    recent = {r.row_id: r.recent for r in roi.trailing_counts(df, 0.5).collect()}
    assert recent == {i: sum(t[i] - 0.5 <= t[j] <= t[i] for j in range(i % 2, len(t), 2)) for i in range(len(t))} | {900: 0}


def test_far_centres_of_many(spark):
    rng = np.random.default_rng(2)
    centres = np.concatenate([rng.random((300, 2)), rng.random((300, 2)) * 0.01 + 50])
    cells = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "cell int, c_x double, c_y double")
    xy = np.concatenate([rng.normal(size=(40, 2)) * 10.0 ** rng.integers(-1, 6, (40, 1)), [[25, 25], [50.005, 50.005]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "row_id long, x double, y double")
    d = np.hypot(*(xy[:, None] - centres[None]).transpose(2, 0, 1))
    got = {r.row_id: r for r in assign.nearest_bucketed(df, cells).collect()}
    assert len(got) == len(xy) and all(d[i, r.cell] <= d[i].min() * (1 + 1e-12) for i, r in got.items())
    twice = assign.nearest_bucketed(df.unionByName(df), cells).collect()  # rows may repeat
    assert len(twice) == 2 * len(xy) and all(r.cell == got[r.row_id].cell for r in twice)


def test_farthest_later_positions():
    rng = np.random.default_rng(1)
    for p in (np.cumsum(rng.normal(size=(700, 2)), 0), np.zeros((5, 2)), np.stack([np.arange(600.0)] * 2, 1), rng.integers(0, 3, (400, 2)).astype(float)):
        want = [max((np.hypot(*(q - a)) for q in p[i + 1 :]), default=0.0) for i, a in enumerate(p)]
        np.testing.assert_allclose(features._farthest_later(p), want)


def test_clustered_keys_have_offsets(spark):
    from stepfield.operators import trajectory

    keys = [*range(500), *(10**15 + k for k in range(500))]
    got = {r.key: r.base for r in trajectory.offsets(spark.createDataFrame([(k, 2) for k in keys], "key long, c long"), "key", "c").collect()}
    assert got == {k: 2 * i for i, k in enumerate(keys)}


def test_one_late_row_does_not_widen_the_search(spark):
    rng = np.random.default_rng(11)
    t = rng.random(20_000) * 100
    segs = [(i, 0.2 * i, 0.2 * i + 0.2) for i in range(500)]
    frame = lambda times: spark.createDataFrame([(i, float(x)) for i, x in enumerate(times)], "row_id long, t double")
    plain, late = (assign.time_candidates(frame(x), segs, 10).count() for x in (t, np.append(t, 1e9)))
    assert plain < 20 * 500 and late <= 1.1 * plain
    tied = np.append(t, np.full(5000, 50.0))  # many rows of one time: only the k least count
    got = assign.time_candidates(frame(tied), segs, 10)
    assert got.count() <= 1.5 * plain
    near = {r.row_id for r in assign.time_knn(frame(tied), [(0, 49.0, 51.0)], 10).collect()}
    assert near == {int(i) for i in sorted(range(len(tied)), key=lambda i: (abs(tied[i] - 50.0), i))[:10]}
    assert assign.time_knn(frame([5.0, 5.0, 5.0]), [(0, 1.0, 2.0)], 2).count() == 2


def test_one_far_point_does_not_widen_the_search(spark):
    rng = np.random.default_rng(12)
    xy = rng.random((20_000, 2)) * 100
    cells = spark.createDataFrame([(i, float(i % 20) * 5, float(i // 20) * 5) for i in range(400)], "cell int, c_x double, c_y double")
    found = []
    for places in (xy, np.vstack([xy, [[1e8, -1e8]]])):
        points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "row_id long, x double, y double")
        found.append(assign._small_candidates(cells, points, 10).count())
    assert found[1] <= 1.5 * found[0] and found[0] < 400 * 400


def test_many_centres_with_one_far(spark):
    rng = np.random.default_rng(13)
    centres = np.vstack([rng.random((600, 2)) * 10, [[1e7, 1e7]]])
    xy = rng.random((3000, 2)) * 10
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(centres)], "cell int, c_x double, c_y double")
    points = spark.createDataFrame([(i % 7, float(x), float(y)) for i, (x, y) in enumerate(xy)], "row_id long, x double, y double")
    want = np.hypot(xy[:, None, 0] - centres[None, :, 0], xy[:, None, 1] - centres[None, :, 1]).argmin(1)
    got = {(r.x, r.y): r.cell for r in assign.nearest(points, cells, few=100).collect()}
    assert got == {(float(x), float(y)): int(c) for (x, y), c in zip(xy, want, strict=True)}
