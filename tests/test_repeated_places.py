"""Boxes and links where places repeat: counted without pairs, joined without holding a table of points in every task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import assign as A
from stepfield.operators import graph as G
from stepfield.operators import roi as R

BOX = "idx long, x_min double, x_max double, y_min double, y_max double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(3)
    xy = np.round(rng.exponential(8, (150, 2)), 1).repeat(3, 0)
    rows = [(i, int(f), float(x), float(y)) for i, (f, (x, y)) in enumerate(zip(rng.integers(0, 3, len(xy)), xy, strict=True))]
    return spark.createDataFrame([*rows, (900, 1, None, 2.0), (901, 1, 1e9, -1e9), (902, 2, float("nan"), 0.0)], "row_id long, frame long, x double, y double")


@pytest.fixture(scope="module")
def boxes(spark):
    rng = np.random.default_rng(4)
    low, side = np.round(rng.exponential(8, (60, 2)), 1).repeat(3, 0), rng.choice([0.0, 1.0, 3.0, 9.0], (60, 2)).repeat(3, 0)
    rows = [(i, float(x), float(x + a), float(y), float(y + b)) for i, ((x, y), (a, b)) in enumerate(zip(low, side, strict=True))]
    return spark.createDataFrame([*rows, (500, 3.0, 1.0, 0.0, 5.0), (501, 3.0, 1.0, 0.0, 5.0), (502, None, 1.0, 0.0, 5.0), (503, None, 1.0, 0.0, 5.0)], BOX)


def touching(boxes):
    b = [r for r in boxes.collect() if r.x_min is not None and r.x_min <= r.x_max and r.y_min <= r.y_max]
    return {(p.idx, q.idx) for p in b for q in b if p.idx < q.idx and p.x_min <= q.x_max and q.x_min <= p.x_max and p.y_min <= q.y_max and q.y_min <= p.y_max}


def test_crop_union_counted(places, boxes):
    want = {r.row_id: (len(r.boxes), min(r.boxes), max(r.boxes)) for r in R.crop_union_indexed(places, boxes).collect()}
    got = R.crop_union_counted(places, boxes).select("row_id", "boxes", "first_box", "last_box").collect()
    assert len(got) == len(want) > 100 and {r.row_id: tuple(r)[1:] for r in got} == want


def test_overlaps_without_a_shuffle_of_pairs(boxes):
    found = R.overlaps(boxes)
    assert "Aggregate" not in plan(found)
    got = [(r.i, r.j) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == touching(boxes)


def test_support_of_repeated_boxes(boxes, monkeypatch):
    edges = []
    real = R.least_reachable
    monkeypatch.setattr(R, "least_reachable", lambda nodes, e, rounds: (edges.append(e.count()), real(nodes, e, rounds))[1])
    got = {r.idx: r.region for r in R.support(boxes).collect()}
    pairs, region = touching(boxes), {r.idx: r.idx for r in boxes.collect()}
    while any(region[i] != region[j] for i, j in pairs):
        for i, j in pairs:
            region[i] = region[j] = min(region[i], region[j])
    for i in region:
        while region[region[i]] != region[i]:
            region[i] = region[region[i]]
    assert got == region and edges[0] * 4 < len(pairs)


def test_mutual_links_without_all_candidates(places):
    want = {tuple(r) for r in R.mutual_links(R.next_frame_candidates(places, 6.0)).collect()}
    got = [tuple(r) for r in R.mutual_next_frame_links(places, 6.0).select("a", "b", "distance").collect()]
    assert len(got) == len(set(got)) > 20 and set(got) == want


def test_points_are_not_held_in_every_task(spark, places):
    assert "Broadcast" not in plan(R.next_frame_candidates(places, 6.0))
    cells = places.withColumn("cell", F.when(F.col("x") < 1e6, F.least(F.floor(F.col("x") / 5), F.lit(9)) * 5 + F.least(F.floor(F.col("y") / 5), F.lit(4))).cast("int"))
    found = G.point_adjacency(cells, G.grid_edges(spark, 10, 5), 2.0)
    assert "SortMergeJoin" in plan(found) and plan(found).count("BroadcastExchange") == 1  # the links of cells
    p = [r for r in cells.collect() if r.cell is not None]
    near = lambda a, b: abs(a.cell // 5 - b.cell // 5) + abs(a.cell % 5 - b.cell % 5) <= 1 and np.hypot(a.x - b.x, a.y - b.y) <= 2
    assert {(r.a, r.b) for r in found.collect()} == {(a.row_id, b.row_id) for a in p for b in p if a.row_id < b.row_id and near(a, b)}


def test_nearest_counts_look_up_a_place_once(spark, places, monkeypatch):
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 5.0), (2, 300.0, 300.0)], "cell int, c_x double, c_y double")
    want = {r.cell: r["count"] for r in A.nearest(places, cells).groupBy("cell").count().collect()}
    looked_up = []
    real = A.nearest
    monkeypatch.setattr(A, "nearest", lambda df, c: (looked_up.append(df.count()), real(df, c))[1])
    assert {r.cell: r.k for r in A.nearest_counts(places, cells).collect()} == want
    assert looked_up == [places.select("x", "y").distinct().count()] and looked_up[0] * 2 < places.count()
