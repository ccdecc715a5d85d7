"""Queries on the test grid against their SQL, with places outside the grid, on its edges and without coordinates, and cells whose steps are all alike."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stepfield.operators import infer as I
from stepfield.plans.registry import ORACLE, QUERIES
from stepfield.plans.common import GRID
from tests.test_twins import plain

PLACES = [(510.0, 50.0), (2000.0, 70.0), (-3.0, -1.0), (0.0, 0.0), (500.0, 100.0), (501.0, 101.0), (50.0, 20.0), (None, 30.0), (60.0, None), (620.0, 10.0)]


@pytest.fixture(scope="module")
def outside(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("outside"))
    rows = ", ".join(f"({i}, {'NULL' if x is None else x}, {'NULL' if y is None else y})" for i, (x, y) in enumerate(PLACES * 3))
    duckdb.sql(
        f"COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(i * 30 AS INT)) AS ts, CAST(i % 2 AS BIGINT) AS user_id, 'view' AS event_type, CAST(x AS DOUBLE) AS value, "
        f"CASE WHEN y IS NULL THEN '{{}}' ELSE '{{\"k\": ' || CAST(y AS VARCHAR) || '}}' END AS props FROM (VALUES {rows}) v(i, x, y)) TO '{path}/events.parquet'"
    )
    return path


@pytest.mark.parametrize("name", ["active_cells", "cell_centroids", "cell_density", "cells_by_predicate", "combine_segments", "counts_round_cells", "grid_assign", "location_count_zero_filled", "split_space_time", "streamed_cell_counts"])
def test_places_outside(spark, outside, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{outside}/events.parquet'")
    df = QUERIES[name](spark, outside)
    columns = sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())


def test_clamped(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("-inf"), 99.0), (float("nan"), float("nan"))], "x double, y double")
    assert [r.c for r in df.select(GRID.cell(clamped=True).alias("c")).collect()] == [45, 4, 49]
    assert [r.c for r in df.select(GRID.cell().alias("c")).collect()] == [None] * 3


def test_cell_without_variance(spark):
    steps = spark.createDataFrame([(0, 1.0, 2.0)] * 4 + [(1, 3.0, 1.0), (1, -1.0, 2.0)], "cell int, dx double, dy double")
    maps = I.snr(steps)
    got = {r.cell: r.map_diffusivity for r in I.conjugate_map(maps, 1.0).collect()}
    assert got[0] is None and got[1] > 0
    forced = I.spurious_zeta(maps.withColumns({"grad_x": F.lit(1.0), "grad_y": F.lit(0.0)}), 1.0)
    assert {r.cell: r.spurious_x is None for r in forced.collect()} == {0: True, 1: False}
