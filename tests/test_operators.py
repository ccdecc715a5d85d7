"""Operators on small literal tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.functions import columns as C
from stepfield.operators import assign, bayes, derive, features, graph, infer, roi, scaling, simulate, tessellate
from stepfield.operators import trajectory as T


def table(spark, rows, schema="n long, x double, y double, t double"):
    return spark.createDataFrame(rows, schema).withColumn("row_id", F.monotonically_increasing_id())


CROP = [(1, 0.1, 0.1, 0.05), (1, 0.45, 0.45, 0.1), (1, 0.85, 0.65, 0.12), (1, 1.1, 0.9, 0.15), (1, 0.9, 1.1, 0.2), (1, 0.6, 0.9, 0.25), (1, 0.4, 0.5, 0.3)]


def test_crop(spark):
    got = T.crop(table(spark, CROP), {"x": 0, "y": 0}, {"x": 1, "y": 1})
    rows = T.compact_ids(got, "seg").where("dx is not null").orderBy("t").collect()
    expected = [(1, 0.1, 0.35, 0.35, 0.05), (1, 0.45, 0.4, 0.2, 0.02), (1, 0.85, 0.25, 0.25, 0.03), (2, 0.6, -0.2, -0.4, 0.05)]
    assert [(r.n, r.x) for r in rows] == [e[:2] for e in expected]
    np.testing.assert_allclose([(r.dx, r.dy, r.dt) for r in rows], [e[2:] for e in expected])


def test_reindex(spark):
    ns = [19782] * 3 + [160801] * 3 + [192719, 193576, 204282, 219796]
    ts = [93.279999, 93.32, 93.4, 452.640015, 452.679993, 452.720001, 516.52002, 518.280029, 541.23999, 570.400024]
    df = table(spark, [(n, 0.0, 0.0, t) for n, t in zip(ns, ts, strict=True)])
    assert [r.n for r in T.reindex(df).orderBy("t").collect()] == [1, 1, 2, 3, 3, 3, 4, 5, 6, 7]


def test_offsets_are_running_sums(spark):
    counts = spark.createDataFrame([(k * k, k % 5) for k in range(300)], "key long, c long")
    got = {r.key: r.base for r in T.offsets(counts, "key", "c", buckets=7).collect()}
    total = 0
    for k in range(300):
        assert got[k * k] == total
        total += k % 5


def test_empty_tables(spark):
    empty = table(spark, [])
    assert T.to_translocations(empty).count() == 0
    assert T.reindex(empty, 1.0).count() == 0
    assert T.frame_counts(T.frames(empty, 1.0)).count() == 0
    assert features.msd(empty).count() == 0


def test_scaler(spark):
    df = table(spark, [(1, 0.0, 1.0, 0.0), (1, 2.0, 5.0, 1.0), (1, 4.0, 3.0, 2.0)])
    s = scaling.whiten(df, ["x", "y"])
    rows = s.scale_points(df).agg(F.avg("x"), F.stddev_pop("x"), F.avg("y"), F.stddev_pop("y")).first()
    np.testing.assert_allclose(list(rows), [0, 1, 0, 1], atol=1e-12)
    joint = scaling.unit_range(df, ["x", "y"], ["x", "y"])
    assert joint.scale_size(10.0) == 2.0
    with pytest.raises(ValueError, match="factors"):
        scaling.unit_range(df, ["x", "t"]).scale_size(1.0)


def test_grid_edges_go_to_the_lower_cell(spark):
    g = tessellate.Grid(0.0, 0.0, 1.0, 1.0, 3, 2)
    df = table(spark, [(1, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0), (1, 3.0, 2.0, 2.0), (1, 3.1, 0.0, 3.0), (1, None, 0.0, 4.0)])
    assert [r.cell for r in df.withColumn("cell", g.cell()).orderBy("t").collect()] == [0, 0, 5, None, None]


def test_bucketed_search_agrees_with_the_literal_one(spark):
    rng = np.random.default_rng(1)
    df = table(spark, [(0, *p, float(i)) for i, p in enumerate(rng.uniform(0, 10, (300, 2)).tolist())])
    cells = tessellate.custom(spark, rng.uniform(0, 3, (40, 2)))
    a = {r.row_id: round(r.distance, 9) for r in assign.nearest(df, cells).collect()}
    b = {r.row_id: round(r.distance, 9) for r in assign.nearest_bucketed(df, cells).collect()}
    assert a == b


def test_kmeans_and_trees(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = table(spark, [(0, *p, float(i)) for i, p in enumerate(points.tolist())])
    got = tessellate.kmeans(df, [(1.0, 1.0), (4.0, 4.0), (1.0, 4.0)]).orderBy("c_x", "c_y").collect()
    assert len(got) == 3 and abs(got[2].c_x - 5) < 0.1
    leaves = tessellate.quadtree(df, 5, 20, 4).collect()
    assert len(leaves) > 4 and sum(r.volume for r in leaves) == pytest.approx(np.prod(points.max(0) - points.min(0)))
    sample = tessellate.bounded_sample(df, 100)
    assert sample.shape == (100, 2)
    nodes, edges = tessellate.growing_gas(sample, 0.5)
    assert len(nodes) >= 3 and edges
    assert tessellate.self_organising_map(sample, 3, 3).shape == (9, 2)
    hexes = tessellate.hexagons(spark, 0.0, 0.0, 5.0, 5.0, 1.0)
    assert graph.hexagon_edges(hexes).groupBy("i").count().agg(F.max("count")).first()[0] == 6


def test_small_cells_are_dropped(spark):
    df = table(spark, [(0, x / 10, 0.0, float(x)) for x in range(100)])
    cells = tessellate.custom(spark, [(1, 0), (3, 0), (5, 0), (7, 0), (9, 0), (50, 50)])
    assert tessellate.drop_small_cells(df, cells, 5).count() == 5


@pytest.mark.parametrize("mode", ["d", "dd", "df"])
def test_closed_form_is_the_optimum(spark, mode):
    rng = np.random.default_rng(3)
    rows = [(0, *p) for p in (rng.normal(0.05, 0.2, (400, 2))).tolist()]
    steps = spark.createDataFrame(rows, "cell int, dx double, dy double").withColumn("dt", F.lit(0.05))
    closed = infer.MODES[mode](steps).first()
    numeric = infer.infer_any_dt(steps, mode).first()
    assert numeric.diffusivity == pytest.approx(closed.diffusivity, rel=1e-5)
    if mode == "dd":
        assert numeric.a_x == pytest.approx(closed.drift_x, rel=1e-5)


def test_bayes_factor_fixture():
    assert 10 ** bayes.log10_factor((0.7, 0.4), (0.8, 0.6), 20, 0.64, 0.95 * 0.64, 0.01) == pytest.approx(0.2974282533, rel=1e-6)
    assert bayes.minimal_steps((0.7, 0.4), (0.0, 0.0), 5, 0.64, 0.64) > 5
    mode, low, high = bayes.diffusivity_interval(50, 0.04, 0.04, 0.0, 0.05)
    assert low < mode < high


def test_incomplete_gamma():
    for x in (0.1, 1.0, 5.0, 30.0):
        assert math.exp(bayes.log_gammainc(1.0, x)) == pytest.approx(1 - math.exp(-x), rel=1e-12)


def test_gradient_of_a_plane(spark):
    g = tessellate.Grid(0.0, 0.0, 2.0, 3.0, 4, 4)
    maps = g.cells(spark).withColumn("v", 2 * F.col("c_x") - 5 * F.col("c_y"))
    for r in derive.gradient(maps, graph.grid_edges(spark, 4, 4), "v").collect():
        assert (r.grad_x, r.grad_y) == (pytest.approx(2), pytest.approx(-5))


def test_curl_of_a_rotation(spark):
    g = tessellate.Grid(0.0, 0.0, 1.0, 1.0, 5, 5)
    maps = g.cells(spark).withColumns({"fx": -F.col("c_y"), "fy": F.col("c_x")})
    rows = derive.grid_curl(maps, 5, 5, "fx", "fy", 1.0, 1.0).collect()
    assert len(rows) == 9 and all(r.curl == pytest.approx(2.0) for r in rows)


def test_sign_groups(spark):
    values = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, -1.0), (3, 3.0), (4, None)], "cell int, value double")
    edges = spark.createDataFrame([(a, b) for a, b in ((0, 1), (1, 2), (2, 3), (3, 4)) for a, b in ((a, b), (b, a))], "i int, j int")
    assert {r.cell: r.group for r in graph.sign_groups(edges, values).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_hull():
    area, perimeter = features.hull_measures(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (2, 0)], float))
    assert (area, perimeter) == (4.0, 8.0)
    assert features.hull_measures(np.array([(1.0, 1.0)])) == (0.0, 0.0)


def test_roi(spark):
    boxes = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0), (1, 1.0, 2.0, 0.0, 1.0), (2, 3.0, 4.0, 0.0, 1.0)], "idx long, x_min double, x_max double, y_min double, y_max double")
    assert {r.idx: r.region for r in roi.support(boxes).collect()} == {0: 0, 1: 0, 2: 2}


def test_simulated_diffusivity_is_recovered(spark):
    walks = simulate.brownian(spark, 200, 50, diffusivity=0.2, dt=0.1)
    steps = T.to_translocations(walks).withColumn("cell", F.lit(0))
    assert infer.infer_d(steps, sigma2=0.0).first().diffusivity == pytest.approx(0.2, rel=0.05)


@pytest.mark.parametrize(
    "make",
    [
        simulate.langevin(lambda x, y, t: 0.1, lambda x, y, t: (-x, -y), 30, 0.05), simulate.random_steps("levy", 30), simulate.waiting_times(30), simulate.fractional(30, 0.3),
        simulate.ornstein_uhlenbeck(30, 1.0, 1.0, 0.1), simulate.switching(30, (0.1, 1.0)), simulate.confined(30, 1.0, 0.3), simulate.diffusing_diffusivity(30, 5.0, 1.0), simulate.self_avoiding(30),
    ],
)
def test_generators_repeat(spark, make):
    a, b = (sorted(map(tuple, simulate.generate(spark, 3, make, seed=5).collect())) for _ in range(2))
    assert a == b and len(a) > 3


def test_error_variance():
    assert C.squared_error(sigma=0.1) == pytest.approx(0.01)
    with pytest.raises(ValueError, match="both"):
        C.squared_error(0.1, 0.01)


def test_quadratic_gradient_of_a_surface(spark):
    g = tessellate.Grid(0.0, 0.0, 1.0, 1.0, 5, 5)
    maps = g.cells(spark).withColumn("v", 3 * F.col("c_x") - F.col("c_y") + 2 * F.col("c_x") * F.col("c_y"))
    got = {r.cell: (r.grad_x, r.grad_y) for r in derive.quadratic_gradient(maps, graph.grid_edges(spark, 5, 5, diagonal=True), "v").collect()}
    assert got[12] == (pytest.approx(3 + 2 * 2.5), pytest.approx(-1 + 2 * 2.5))


def test_spherical_volume(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (0, 2.0, 0.0), (0, 1.0, 0.5), (1, 4.0, 0.0), (2, 9.0, 9.0)], "cell int, x double, y double")
    edges = spark.createDataFrame([(0, 1), (1, 0)], "i int, j int")
    got = {r.cell: r.radius for r in infer.spherical_volume(points, edges).collect()}
    assert got == {0: pytest.approx(3.0), 1: pytest.approx(2.0), 2: 0.0}


def test_balls_hold_all_points_in_any_partitioning(spark):
    rng = np.random.default_rng(12)
    rows = [(c, *map(float, p)) for c in range(3) for p in rng.normal(c, 1 + c, (300, 2))] + [(3, 1.0, 1.0)] * 2 + [(4, None, 1.0)]
    points = spark.createDataFrame(rows, "cell int, x double, y double")
    none = spark.createDataFrame([], "i int, j int")
    got = [{r.cell: r.radius for r in infer.spherical_volume(points.repartition(k), none).collect()} for k in (1, 7)]
    assert got[0] == got[1] and set(got[0]) == {0, 1, 2, 3} and got[0][3] == 0
    for c in range(3):
        p = np.array([r[1:] for r in rows if r[0] == c])
        centre, radius = infer._ball(infer._hull(p))
        assert got[0][c] == radius and np.hypot(*(p - centre).T).max() <= radius * (1 + 1e-9)
        far = max(np.hypot(*(p - q).T).max() for q in p)
        assert far / 2 <= radius <= 1.2 * far / 3**0.5
