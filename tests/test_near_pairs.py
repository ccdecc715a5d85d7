"""Listed pairs: each found once, dealt over tasks by their rows, and rounded without decimal text."""

import duckdb
import numpy as np

import __spark_entry__  # noqa: F401
from stepfield.operators import graph as G
from stepfield.operators import roi as R
from stepfield.plans.common import rounded_distance
from stepfield.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_dealt_over_tasks_and_rounded_by_arithmetic(spark, sf, monkeypatch):
    found = QUERIES["next_frame_candidates"](spark, sf)
    assert " round(" not in plan(found) and "hashpartitioning(frame" in plan(found) and ", 8), REPARTITION_BY_NUM" in plan(found)
    monkeypatch.setattr(R, "pair_tasks", lambda rows: 13)
    assert found.count() == QUERIES["next_frame_candidates"](spark, sf).count() > 0


def test_rounding_is_that_of_sql(spark):
    values = np.r_[0.0, 1e-7, 5e-7, 10.0, np.random.default_rng(2).uniform(0, 10, 5000), np.sqrt(np.arange(200) / 1e4)]
    got = rounded_distance(spark.createDataFrame([(float(v),) for v in values], "distance double")).toPandas().distance
    want = duckdb.execute("SELECT list_transform(?, lambda v: round(v, 6))", [values.tolist()]).fetchone()[0]
    assert got.tolist() == [float(v) for v in want]


def test_adjacent_points_meet_once(spark):
    """Links of cells hold in one direction only here: of a pair, the smaller row's cell is the link's first."""
    rng = np.random.default_rng(1)
    rows = [(int(i), float(x), float(y), int(x // 3)) for i, (x, y) in zip(rng.permutation(300), np.round(rng.uniform(-4, 12, (300, 2)), 1), strict=True)]
    points = spark.createDataFrame(rows, "row_id long, x double, y double, cell int")
    links = spark.createDataFrame([(0, 1), (2, 1), (1, 3)], "i int, j int")
    found = G.point_adjacency(points, links, 2.0)
    got = [(r.a, r.b, r.distance) for r in found.collect()]
    linked = {(r.i, r.j) for r in links.collect()}
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and (p[3] == q[3] or (p[3], q[3]) in linked) and np.hypot(p[1] - q[1], p[2] - q[2]) <= 2}
    assert {r[:2] for r in got} == want and len(got) == len(want) > 300
    assert all(abs(d - np.hypot(*(np.subtract(*({r[0]: r[1:3] for r in rows}[k] for k in (a, b)))))) < 1e-12 for a, b, d in got[:50])
    assert found._jdf.queryExecution().analyzed().toJSON().count("expressions.CreateNamedStruct") == 5  # buckets that a point looks in, nine before
