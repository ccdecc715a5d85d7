"""Smooth maps by edge joins: at the result the whole cost has no slope."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import infer


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    rows = [(c, *(d * rng.standard_normal(2)).tolist()) for c, d in enumerate((0.1, 0.2, 0.3, 0.15)) for _ in range(200 + 50 * c)]
    steps = spark.createDataFrame(rows, "cell int, dx double, dy double").withColumn("dt", F.lit(0.05))
    cells = infer.statistics(steps).withColumn("volume", F.col("cell") + 1.0).cache()
    edges = [(0, 1), (1, 2), (0, 2)]
    return cells, spark.createDataFrame([e for a, b in edges for e in ((a, b), (b, a))], "i int, j int"), edges


@pytest.mark.parametrize("prior", [0.0, 1.0])
@pytest.mark.parametrize("mode", ["d", "df"])
def test_slope_vanishes(case, prior, mode):
    cells, graph, edges = case
    found = {r.cell: r for r in infer.smooth_joined(cells, graph, prior, mode, tolerance=1e-9).collect()}
    rows = {r.cell: r for r in cells.collect()}
    d = np.array([found[c].diffusivity for c in range(4)])

    def cost(d):
        out = 0.0
        for c, r in rows.items():
            scale = d[c] * r.dt + infer.SIGMA2
            left = r.s if mode == "d" else r.s - (r.m_x**2 + r.m_y**2) / r.k
            out += r.k * np.log(scale) + left / (4 * scale)
        return out + prior * sum((rows[a].volume + rows[b].volume) * (d[a] - d[b]) ** 2 for a, b in edges)

    for c in range(4):
        h = 1e-5 * np.eye(4)[c]
        up, down = cost(d + h), cost(d - h)
        assert abs(up - down) / 2e-5 < 1e-3 * (up + down - 2 * cost(d)) / 1e-10  # a step of a thousandth would be needed at most
    if mode == "df":
        assert found[1].a_x == pytest.approx(rows[1].m_x / (rows[1].k * rows[1].dt * d[1]))


def test_unsettled_raises(case):
    with pytest.raises(RuntimeError):
        infer.smooth_joined(case[0], case[1], 1e6, rounds=4)
