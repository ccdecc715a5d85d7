"""Cluster and map files: a literal file, odd lines, files of many splits and parts, round trips."""

import pytest
from pyspark.sql import functions as F

from stepfield.sources import clusters

TEXT = """# made by hand
1 2 3
ZONE: 1
NUMBER_OF_TRANSLOCATIONS: 2
X-CENTRE: 0.5
Y-CENTRE: -1e-3
AREA: 2
AREA_CONVHULL: 1.5
NUMBER_OF_LEFT_NEIGHBOURS: 0
NUMBER_OF_RIGHT_NEIGHBOURS: 2
RIGHT_NEIGHBOURS: 2\t3\t
COLOUR: red
DX\tDY\tDT
0.1\t-0.2\t0.05
; a remark

-1e-3 .5 1
ZONE: 3
NUMBER_OF_TRANSLOCATIONS: 2
X-CENTRE: 4
NUMBER_OF_LEFT_NEIGHBOURS: 1
LEFT_NEIGHBOURS: 1
DX DY DT
7 8 9
"""


@pytest.mark.parametrize("split", ["128m", "40b"])
def test_literal_file(spark, tmp_path, split):
    (tmp_path / "a.cluster").write_text(TEXT)
    for key, value in (("spark.sql.files.maxPartitionBytes", split), ("spark.sql.files.openCostInBytes", "1b" if split == "40b" else "4m")):
        spark.conf.set(key, value)
    try:
        got = clusters.read_cluster(spark, str(tmp_path / "a.cluster"))
        assert {tuple(r) for r in got.cells.select("cell", "k", "c_x", "c_y", "area", "volume").collect()} == {(0, 2, 0.5, -0.001, 2.0, 1.5), (2, 2, 4.0, None, None, None)}
        assert {tuple(r) for r in got.edges.collect()} == {(0, 1, 1), (0, 2, 1), (2, 0, -1)}
        assert [tuple(r) for r in got.steps.orderBy("cell", "row_id").select("cell", "dx", "dy", "dt").collect()] == [(0, 0.1, -0.2, 0.05), (0, -0.001, 0.5, 1.0), (2, 7.0, 8.0, 9.0)]
        assert [tuple(r) for r in clusters.mismatches(got).collect()] == [(2, "TRANSLOCATIONS", 2, 1)]
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)


@pytest.mark.parametrize("parts", [1, 7])
def test_round_trip_with_a_hot_cell(spark, tmp_path, parts):
    cells = spark.createDataFrame([(0, 0.1, 0.2), (1, 1.0, 0.2), (2, 0.1, 3.0), (5, None, 1 / 3)], "cell int, c_x double, c_y double")
    edges = clusters.sided(spark.createDataFrame([(0, 1), (1, 0), (0, 2), (2, 0)], "i int, j int"), cells)
    rows = [(1, i / 7, -i / 3, 0.05) for i in range(500)] + [(0, 0.1, 0.2, 0.3)] * 3 + [(9, 1.0, 1.0, 1.0)]
    steps = spark.createDataFrame(rows, "cell int, dx double, dy double, dt double")
    path = str(tmp_path / "out")
    clusters.write_cluster(cells, edges, steps, path, parts)
    got = clusters.read_cluster(spark, path)
    assert sorted(tuple(r) for r in got.steps.drop("row_id").collect()) == sorted(r for r in rows if r[0] != 9)
    assert {tuple(r) for r in got.edges.collect()} == {(0, 1, 1), (1, 0, -1), (0, 2, 2), (2, 0, -2)}
    assert {r.cell: (r.k, r.c_x, r.c_y) for r in got.cells.collect()} == {0: (3, 0.1, 0.2), 1: (500, 1.0, 0.2), 2: (0, 0.1, 3.0), 5: (0, None, 1 / 3)}
    assert clusters.mismatches(got).count() == 0


def test_maps(spark, tmp_path):
    maps = spark.createDataFrame([(n, n + 1, n / 3, -n / 7, None if n == 3 else float("inf") if n == 4 else n / 9) for n in range(40)], "cell int, k long, c_x double, c_y double, diffusivity double")
    for parts in (1, 5):
        path = str(tmp_path / f"maps{parts}")
        clusters.write_vmesh(maps, path, {"Inference Mode": "D", "Diffusion Prior": 0.5}, parts)
        got, header = clusters.read_vmesh(spark, path)
        assert header == {"Inference Mode": "D", "Diffusion Prior": "0.5"}
        want = maps.withColumn("diffusivity", F.when(~F.col("cell").isin(3, 4), F.col("diffusivity")))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.cluster").write_text("\n")
    got = clusters.read_cluster(spark, str(tmp_path / "empty.cluster"))
    assert got.cells.count() == got.edges.count() == got.steps.count() == clusters.mismatches(got).count() == 0
