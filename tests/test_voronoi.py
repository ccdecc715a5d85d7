"""Voronoi polygons against half-plane intersection by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import voronoi

BOX = (-0.5, 1.5, -0.25, 1.25)


def brute(p):
    """Ridge lengths by pair and areas: each bisector, and box side, cut by all other half-planes."""
    x0, x1, y0, y1 = BOX
    sides = [(np.array([-1.0, 0]), -x0), (np.array([1.0, 0]), x1), (np.array([0, -1.0]), -y0), (np.array([0, 1.0]), y1)]
    edges, area = {}, np.zeros(len(p))
    for i in range(len(p)):
        planes = [(j, p[j] - p[i], (p[j] @ p[j] - p[i] @ p[i]) / 2) for j in range(len(p)) if j != i] + [(-1, n, b) for n, b in sides]
        normal, bound = np.array([n for _, n, _ in planes]), np.array([b for *_, b in planes])
        for at, (j, n, b) in enumerate(planes):
            h = (b - n @ p[i]) / np.hypot(*n)
            start, way = p[i] + n / np.hypot(*n) * h, np.array([-n[1], n[0]]) / np.hypot(*n)
            keep = np.arange(len(planes)) != at
            a, c = normal[keep] @ way, bound[keep] - normal[keep] @ start
            if (c[np.abs(a) < 1e-12] < 0).any():
                continue
            high, low = (c[a > 1e-12] / a[a > 1e-12]).min(), (c[a < -1e-12] / a[a < -1e-12]).max()
            if high - low > 1e-9:
                area[i] += (high - low) * h / 2
                if j >= 0:
                    edges[i, j] = high - low
    return edges, area


@pytest.mark.parametrize("group", [512, 5])
@pytest.mark.parametrize("clustered", [False, True])
def test_polygons(spark, group, clustered):
    rng = np.random.default_rng(3)
    p = rng.random((80, 2))
    if clustered:
        p[:50] = 0.4 + p[:50] / 1000
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "cell int, c_x double, c_y double")
    got = voronoi.polygons(cells, BOX, group).cache()
    edges, area = brute(p)
    found = {(r.i, r.j): r.ridge for r in voronoi.ridges(got).collect()}
    assert found.keys() == edges.keys() and all(abs(v - edges[k]) < 1e-7 for k, v in found.items())
    sizes = {r.cell: r.volume for r in voronoi.volumes(got).collect()}
    assert all(abs(sizes[i] - area[i]) < 1e-9 for i in range(len(p))) and abs(sum(sizes.values()) - 3.0) < 1e-9


def test_edge_cases(spark):
    schema = "cell int, c_x double, c_y double"
    assert voronoi.polygons(spark.createDataFrame([], schema), BOX).count() == 0
    rows = [(4, 0.5, 0.5), (2, 0.5, 0.5), (7, None, 0.1), (8, 9.0, 0.1)]
    one = voronoi.polygons(spark.createDataFrame(rows, schema), BOX)
    assert [(r.cell, round(r.volume, 9), r.closed) for r in voronoi.volumes(one).collect()] == [(2, 3.0, False)]
    line = voronoi.polygons(spark.createDataFrame([(i, i / 4, 0.0) for i in range(5)], schema), BOX)
    assert {(r.i, r.j) for r in voronoi.ridges(line).collect()} == {(i, i + d) for i in range(5) for d in (-1, 1) if 0 <= i + d < 5}
    grid = voronoi.polygons(spark.createDataFrame([(i * 4 + j, i / 4, j / 4) for i in range(4) for j in range(4)], schema), BOX)
    assert voronoi.ridges(grid).count() == 48  # corners in common are no ridges


def test_point_densities(spark):
    df = spark.range(60).select((F.rand(1)).alias("x"), F.rand(2).alias("y")).withColumn("x", F.when(F.rand(3) < 0.1, F.lit(0.25)).otherwise(F.col("x"))).withColumn("y", F.when(F.col("x") == 0.25, F.lit(0.25)).otherwise(F.col("y"))).cache()
    own = voronoi.point_densities(df, BOX).collect()
    assert sum(r.k for r in own) == 60 and abs(sum(r.area for r in own) - 3.0) < 1e-9
    wide = {(r.x, r.y): r for r in voronoi.point_densities(df, BOX, 1).collect()}
    assert all(wide[r.x, r.y].area > r.area and wide[r.x, r.y].k > r.k for r in own)


@pytest.mark.parametrize("grid", [False, True])
def test_deleted_cells_are_mended_as_if_cut_anew(spark, grid):
    rng = np.random.default_rng(12)
    at = [(float(k // 7), float(k % 7)) for k in range(49)] if grid else rng.uniform(0, 6, (60, 2)).tolist()
    box = (-0.5, 6.5, -0.5, 6.5)
    rows = [(k, *c) for k, c in enumerate(at)]
    schema = "cell long, c_x double, c_y double"
    gone = {8, 9, 10, 16, 24, 40, 48, 3}
    before = voronoi.polygons(spark.createDataFrame(rows, schema), box).cache()
    mended = voronoi.without(before, spark.createDataFrame([(k,) for k in [*gone, 8, 777]], "cell long"), box).cache()
    anew = voronoi.polygons(spark.createDataFrame([r for r in rows if r[0] not in gone], schema), box)
    area = lambda cells: {r.cell: r.volume for r in voronoi.volumes(cells).collect()}
    edges = lambda cells: {(r.i, r.j): r.ridge for r in voronoi.ridges(cells).collect()}
    assert area(mended) == pytest.approx(area(anew)) and edges(mended) == pytest.approx(edges(anew))
    assert sum(area(mended).values()) == pytest.approx(49)
    assert not voronoi.without(before, spark.createDataFrame(rows, schema), box).count()
    assert area(voronoi.without(before, spark.createDataFrame([], "cell long"), box)) == pytest.approx(area(before))
