"""Queries on cells: assignment joins, counts, time windows, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.operators import assign as A
from stepfield.operators import graph as G
from stepfield.operators import tessellate as S
from stepfield.plans.common import CELL, CELLS, EDGES, GRID, STEPS, WALK, on_grid, r, rounded, rounded_distance, steps, walk
from stepfield.plans.registry import query

D = "sqrt((x - c_x) * (x - c_x) + (y - c_y) * (y - c_y))"
T0, T1, DAY = 1704067200.0, 1706659200.0, 86400.0
_SEGS = "s AS (SELECT CAST(i AS INT) AS seg, 1704067200e0 + i * {shift} AS t0, 1704067200e0 + i * {shift} + {width} AS t1 FROM range({k}) r(i))"
_TUMBLING = _SEGS.format(shift="86400e0", width="86400e0", k=30)
_SLIDING = _SEGS.format(shift="86400e0", width="259200e0", k=28)


def _cells(spark):
    return GRID.cells(spark)


def _nearest(spark, sf):
    return A.nearest(walk(spark, sf), _cells(spark))


@query(f"WITH {WALK} SELECT row_id, {CELL} AS cell FROM p")
def grid_assign(spark, sf):
    return on_grid(walk(spark, sf)).select("row_id", "cell")


@query(f"WITH {WALK}, {CELLS} SELECT row_id, cell, {r('sqrt(d)', 'distance')} FROM (SELECT row_id, cell, (x - c_x) * (x - c_x) + (y - c_y) * (y - c_y) AS d FROM p, c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cell) = 1)")
def nearest_centre(spark, sf):
    return rounded(_nearest(spark, sf).select("row_id", "cell", "distance"))


#: Places on a lattice of width 1 that hold a location: more centres than a literal array takes.
_PLACES = "k AS (SELECT DISTINCT CAST(round(x) * 1000 + round(y) AS BIGINT) AS cell, round(x) AS c_x, round(y) AS c_y FROM p)"


@query(f"WITH {WALK}, {_PLACES} SELECT row_id, min(s.cell) AS cell, {r('min(s.d)', 'distance')} FROM (SELECT row_id, arg_min({{'cell': cell, 'd': {D}}}, ((x - c_x) * (x - c_x) + (y - c_y) * (y - c_y), cell)) AS s FROM p, k GROUP BY row_id) GROUP BY row_id")
def nearest_centre_bucketed(spark, sf):
    """The nearest of all places rounded to whole numbers."""
    df = walk(spark, sf)
    places = df.select((F.round("x") * 1000 + F.round("y")).cast("long").alias("cell"), F.round("x").alias("c_x"), F.round("y").alias("c_y")).distinct()
    return rounded(A.nearest_bucketed(df, places).select("row_id", "cell", "distance"))


_HEX = "h AS (SELECT CAST(i AS INT) AS cell, (i % 8) * 80e0 + ((i // 8) % 2) * 40e0 AS c_x, (i // 8) * (120e0 / sqrt(3)) AS c_y FROM range(24) r(i))"


@query(f"WITH {WALK}, {_HEX} SELECT cell, count(*) AS k FROM (SELECT row_id, cell FROM p, h QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY (x - c_x) * (x - c_x) + (y - c_y) * (y - c_y), cell) = 1) GROUP BY cell")
def hex_assign(spark, sf):
    return A.nearest(walk(spark, sf), S.hexagons(spark, 0.0, 0.0, 500.0, 100.0, 40.0)).groupBy("cell").agg(F.count("*").alias("k"))


@query(f"WITH {WALK}, {CELLS} SELECT row_id, cell FROM p JOIN c ON {D} <= 30")
def radius_join(spark, sf):
    return A.within(walk(spark, sf), _cells(spark), 30.0).select("row_id", "cell")


_OWN = f"o AS (SELECT row_id, x, y, {CELL} AS cell FROM p), k AS (SELECT c.cell, c_x, c_y, count(o.cell) AS k FROM c LEFT JOIN o ON o.cell = c.cell GROUP BY ALL)"


@query(
    f"WITH {WALK}, {CELLS}, {_OWN} SELECT row_id, o.cell FROM o JOIN k ON o.cell = k.cell WHERE k >= 200 "
    f"UNION ALL SELECT row_id, cell FROM (SELECT p.row_id, k.cell FROM p, k WHERE k.k < 200 QUALIFY row_number() OVER (PARTITION BY k.cell ORDER BY {D}, p.row_id) <= 200)"
)
def knn_points_per_cell(spark, sf):
    df = walk(spark, sf)
    return A.knn_points(on_grid(df), df, _cells(spark), 200)


_NEAR = f"o AS (SELECT row_id, x, y, cell, {D} AS distance FROM (SELECT p.*, {CELL} AS k FROM p) p JOIN c ON c.cell = p.k)"


def _assigned(spark, sf):
    c = _cells(spark)
    d = F.hypot(F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y"))
    return on_grid(walk(spark, sf)).join(F.broadcast(c), "cell").withColumn("distance", d).drop("c_x", "c_y", "volume")


@query(f"WITH {WALK}, {CELLS}, {_NEAR} SELECT row_id, cell FROM o QUALIFY row_number() OVER (PARTITION BY cell ORDER BY distance, row_id) <= 20")
def cap_points_per_cell(spark, sf):
    return A.cap_points(_assigned(spark, sf), 20).select("row_id", "cell")


@query(f"WITH {WALK}, {CELLS}, {_NEAR} SELECT row_id, cell FROM o WHERE distance <= 15")
def max_radius(spark, sf):
    return A.max_radius(_assigned(spark, sf), 15.0).select("row_id", "cell")


@query(f"WITH {WALK}, {CELLS}, {_NEAR} SELECT row_id, cell FROM (SELECT *, count(*) OVER (PARTITION BY cell) AS k, row_number() OVER (PARTITION BY cell ORDER BY distance, row_id) AS q FROM o WHERE distance <= 10 + cell) WHERE k >= cell AND q <= 100")
def bounds_per_cell(spark, sf):
    limits = _cells(spark).select("cell", F.col("cell").alias("least"), F.lit(100).alias("most"), (F.col("cell") + 10.0).alias("radius"))
    return A.bounded_by(_assigned(spark, sf), limits).select("row_id", "cell")


@query(f"WITH {WALK}, o AS (SELECT row_id, {CELL} AS cell FROM p) SELECT row_id, cell FROM o WHERE cell IN (SELECT cell FROM o GROUP BY cell HAVING count(*) >= 200)")
def min_count_having(spark, sf):
    return A.min_count(on_grid(walk(spark, sf)), 200).select("row_id", "cell")


@query(f"WITH {WALK} SELECT row_id, cell FROM (SELECT row_id, {CELL} AS cell FROM p) WHERE cell % 3 > 0")
def active_cells(spark, sf):
    return A.active_only(on_grid(walk(spark, sf)), _cells(spark).withColumn("label", F.col("cell") % 3)).select("row_id", "cell")


@query(f"WITH {WALK}, {CELLS} SELECT row_id, cell FROM (SELECT row_id, cell, {D} AS d FROM p JOIN c ON {D} <= 40) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cell) = 1")
def nearest_of_several(spark, sf):
    return A.one_cell(A.within(walk(spark, sf), _cells(spark), 40.0))


@query(f"WITH {WALK} SELECT {CELL} AS cell, count(*) AS k, {r('avg(x)', 'm_x', 4)}, {r('avg(y)', 'm_y', 4)} FROM p GROUP BY 1")
def cell_centroids(spark, sf):
    return rounded(A.centroids(on_grid(walk(spark, sf))), 4)


@query(f"WITH {WALK} SELECT {CELL} AS cell, {r('count(*) / 1000e0', 'density')} FROM p GROUP BY 1")
def cell_density(spark, sf):
    k = A.counts(on_grid(walk(spark, sf)), _cells(spark)).where("k > 0")
    return rounded(k.join(_cells(spark), "cell").select("cell", (F.col("k") / F.col("volume")).alias("density")))


@query(f"WITH {WALK}, {_TUMBLING} SELECT row_id, seg FROM p JOIN s ON t >= t0 AND t < t1")
def tumbling_window(spark, sf):
    return A.windows(walk(spark, sf), T0, T1, DAY).select("row_id", "seg")


@query(f"WITH {WALK}, {_SLIDING} SELECT row_id, seg FROM p JOIN s ON t >= t0 AND t < t1")
def sliding_window(spark, sf):
    return A.windows(walk(spark, sf), T0, T1, 3 * DAY, DAY).select("row_id", "seg")


@query(f"WITH {WALK}, {_SLIDING} SELECT seg, count(*) AS k FROM p JOIN s ON t >= t0 AND t < t1 GROUP BY seg")
def segment_interval_join(spark, sf):
    segs = spark.createDataFrame(A.segments(T0, T1, 3 * DAY, DAY), "seg int, t0 double, t1 double")
    return A.in_segments(walk(spark, sf), segs).groupBy("seg").agg(F.count("*").alias("k"))


@query(f"WITH {WALK}, {_SLIDING} SELECT seg, row_id, CAST(row_number() OVER (PARTITION BY seg ORDER BY abs(t - (t0 + t1) / 2), row_id) AS INT) AS rank FROM p, s QUALIFY rank <= 15")
def time_knn(spark, sf):
    return A.time_knn(walk(spark, sf), A.segments(T0, T1, 3 * DAY, DAY), 15)


@query(f"WITH {WALK}, {_TUMBLING} SELECT CAST(seg * 50 + {CELL} AS BIGINT) AS id, count(*) AS k FROM p JOIN s ON t >= t0 AND t < t1 GROUP BY 1")
def space_time_cells(spark, sf):
    return A.windows(on_grid(walk(spark, sf)), T0, T1, DAY).groupBy(A.combined_id(50).alias("id")).agg(F.count("*").alias("k"))


@query(f"WITH {WALK}, {_TUMBLING} SELECT seg, {CELL} AS cell, count(*) AS k FROM p JOIN s ON t >= t0 AND t < t1 GROUP BY ALL")
def split_space_time(spark, sf):
    joined = A.windows(on_grid(walk(spark, sf)), T0, T1, DAY).groupBy(A.combined_id(50).alias("id")).agg(F.count("*").alias("k"))
    return A.split_id(joined, 50).select("seg", "cell", "k")


@query(f"WITH {WALK} SELECT CAST(s * 50 + {CELL} AS BIGINT) AS id, count(*) AS k FROM (SELECT *, CASE WHEN t < 1705363200 THEN 0 ELSE 1 END AS s FROM p) GROUP BY 1")
def combine_segments(spark, sf):
    df = on_grid(walk(spark, sf))
    halves = [df.where("t < 1705363200"), df.where("t >= 1705363200")]
    return A.combine_segments([h.groupBy("cell").agg(F.count("*").alias("k")) for h in halves], 50).select("id", "k")


@query(f"WITH {STEPS}, f AS (SELECT t, count(*) AS k FROM p GROUP BY t), b AS (SELECT t, k, coalesce(sum(k) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM f) SELECT {r('t')}, k, CAST(base // 1000 AS INT) AS seg FROM b")
def equal_count_segments(spark, sf):
    return rounded(A.equal_count_segments(steps(spark, sf), 1000))


@query(f"WITH {WALK}, {EDGES}, o AS (SELECT row_id, x, y, {CELL} AS cell FROM p), l AS (SELECT i, j FROM e UNION SELECT i, i FROM g) SELECT a.row_id AS a, b.row_id AS b, {r('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', 'distance')} FROM o a JOIN l ON l.i = a.cell JOIN o b ON b.cell = l.j AND a.row_id < b.row_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2")
def point_adjacency(spark, sf):
    return rounded_distance(G.point_adjacency(on_grid(walk(spark, sf)), G.grid_edges(spark, 10, 5), 2.0))


@query(f"WITH {WALK}, {EDGES}, b AS (SELECT * FROM (VALUES (0, 0e0, 100e0, 0e0, 50e0), (1, 50e0, 200e0, 20e0, 90e0)) v(cell, x_min, x_max, y_min, y_max)) SELECT row_id, cell FROM p JOIN b ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max")
def box_join(spark, sf):
    boxes = spark.createDataFrame([(0, 0.0, 100.0, 0.0, 50.0), (1, 50.0, 200.0, 20.0, 90.0)], "cell int, x_min double, x_max double, y_min double, y_max double")
    return A.in_boxes(walk(spark, sf), boxes).select("row_id", "cell")
