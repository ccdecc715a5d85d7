"""Diffusivity and potential by conjugate gradients on the edge table, against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import graph, infer, potential


def pair_table(spark, pairs):
    return spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "i int, j int")


def dense(at, pairs):
    n = len(at)
    gx, gy, lap = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
    near = [[] for _ in range(n)]
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    for i, js in enumerate(near):
        if js:
            inverse = np.linalg.pinv(at[js] - at[i])
            for g, w in ((gx, inverse[0]), (gy, inverse[1])):
                g[i, js] += w
                g[i, i] -= w.sum()
            lap[i, i] += len(js)
            lap[i, js] -= 1
    return gx, gy, lap


@pytest.fixture(scope="module")
def case(spark):
    """Nine cells on a jittered grid and one without neighbours, steps with drift."""
    rng = np.random.default_rng(7)
    at = np.array([(i // 3, i % 3) for i in range(9)], float) + rng.uniform(-0.2, 0.2, (9, 2))
    at = np.vstack([at, [[9.0, 9.0]]])
    pairs = [(i, j) for i in range(9) for j in range(i) if abs(i // 3 - j // 3) + abs(i % 3 - j % 3) == 1]
    rows = [(c, *(rng.normal([0.02 * (at[c, 0] - 1.5), -0.01], 0.1 + 0.02 * (c % 3), 2)).tolist()) for c in range(10) for _ in range(80 + 10 * c)]
    steps = spark.createDataFrame(rows, "cell int, dx double, dy double").withColumn("dt", F.lit(0.05))
    places = spark.createDataFrame([(c, *at[c].tolist()) for c in range(10)], "cell int, c_x double, c_y double")
    return infer.statistics(steps).join(places, "cell").cache(), pair_table(spark, pairs), at, pairs


def test_gradient_weights(spark, case):
    cells, edges, at, pairs = case
    gx, gy, _ = dense(at, pairs)
    value = np.sin(np.arange(10.0))
    found = potential.gradients(spark.createDataFrame([(c, float(v)) for c, v in enumerate(value)], "cell int, v double"), potential.gradient_weights(cells, edges), "v")
    for r in found.collect():
        assert (r.gx, r.gy) == pytest.approx(((gx @ value)[r.cell], (gy @ value)[r.cell]))
    line = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 2.0)], "cell int, c_x double, c_y double")
    only = potential.gradient_weights(line, pair_table(spark, [(0, 1)])).where("i = 0").first()
    assert (only.wx, only.wy) == pytest.approx((0.2, 0.4))


def test_conjugate_gradients_agree_with_a_dense_solve(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 12))
    a, b = a @ a.T + np.eye(12), rng.normal(size=12)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "cell int, j int, a double").cache()
    apply = lambda x: entries.join(x.select(F.col("cell").alias("j"), "p"), "j").groupBy("cell").agg(F.sum(F.col("a") * F.col("p")).alias("ap"))
    rhs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "cell int, b double")
    x = dict(potential.conjugate_gradients(apply, rhs, tolerance=1e-10).collect())
    assert [x[i] for i in range(12)] == pytest.approx(np.linalg.solve(a, b), rel=1e-6)
    with pytest.raises(RuntimeError):
        potential.conjugate_gradients(apply, rhs, tolerance=1e-10, steps=3)


def test_cost_has_no_slope(case):
    cells, edges, at, pairs = case
    v_prior, d_prior = 0.05, 0.05
    found = {r.cell: r for r in potential.infer_dv(cells, edges, v_prior, d_prior).collect()}
    rows = {r.cell: r for r in cells.collect()}
    gx, gy, lap = dense(at, pairs)
    k, s, mx, my, dt = (np.array([float(rows[c][f]) for c in range(10)]) for f in ("k", "s", "m_x", "m_y", "dt"))

    def cost(d, v):
        u, ax, ay = d * dt, gx @ v, gy @ v
        scale = u + infer.SIGMA2
        return (k * np.log(scale) + (s + 2 * u * (mx * ax + my * ay) + k * u**2 * (ax**2 + ay**2)) / (4 * scale)).sum() + v_prior * v @ lap @ v + d_prior * d @ lap @ d

    d, v = (np.array([found[c][f] for c in range(10)]) for f in ("diffusivity", "potential"))
    assert v.min() == 0 and v.max() > 0
    for c in range(9):
        for move in ("d", "v"):
            h = 1e-5 * np.eye(10)[c]
            up, down = (cost(d + x, v) if move == "d" else cost(d, v + x) for x in (h, -h))
            curve = (up + down - 2 * cost(d, v)) / 1e-10
            assert abs(up - down) / 2e-5 < 1e-2 * curve * (d.max() if move == "d" else v.max())  # a step of a hundredth at most
    assert found[3].force_x == pytest.approx(-(gx @ v)[3]) and found[9].force_x == 0


def test_operator_on_many_cells(spark):
    """A hundred thousand cells, without a matrix: the quadratic form, by numpy on the grid."""
    side = 316
    cells = graph_cells(spark, side)
    links = potential.gradient_weights(cells, graph.grid_edges(spark, side, side))
    sums = links.groupBy(F.col("i").alias("cell")).agg(F.sum("wx").alias("k_x"), F.sum("wy").alias("k_y"), F.count("*").cast("double").alias("degree"))
    own = cells.join(sums, "cell").select("cell", "k_x", "k_y", "degree", F.lit(2.0).alias("weight"), F.lit(1.0).alias("unit"))
    p = cells.select("cell", F.sin(F.col("cell") * 1.7).alias("p"))
    got = potential._potential_operator(own, links, 0.5)(p).join(p, "cell").agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
    v = np.sin(np.arange(side * side) * 1.7).reshape(side, side)
    slopes = [np.gradient(v, axis=a) for a in (0, 1)]
    steps = sum((np.diff(v, axis=a) ** 2).sum() for a in (0, 1))
    assert got == pytest.approx(2 * sum((g**2).sum() for g in slopes) + 2 * 0.5 * steps, rel=1e-9)


def graph_cells(spark, side):
    return spark.range(side * side).select(F.col("id").cast("int").alias("cell"), F.floor(F.col("id") / side).cast("double").alias("c_x"), (F.col("id") % side).cast("double").alias("c_y"))
