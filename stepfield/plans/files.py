"""Cells, their neighbours and steps, and maps, written as text files and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.operators import graph as G
from stepfield.operators import infer as I
from stepfield.operators import trajectory as T
from stepfield.plans.common import CELL, CELLS, EDGES, GRID, MOVES, WALK, on_grid, r, rounded, walk
from stepfield.plans.registry import query
from stepfield.sources import clusters
from stepfield.sources.storage import folder

_SIDES = {"left": "b.gx < a.gx", "right": "b.gx > a.gx", "top": "b.gy > a.gy", "bottom": "b.gy < a.gy"}


@query(
    f"WITH {WALK}, {MOVES}, {CELLS}, {EDGES}, m AS (SELECT {CELL} AS cell, count(*) AS k, sum(dx) AS s_x, sum(dy) AS s_y, sum(dt) AS s_t FROM d GROUP BY 1), "
    "h AS (SELECT a.i AS cell, " + ", ".join(f"count(*) FILTER ({w}) AS n_{s}" for s, w in _SIDES.items()) + " FROM e JOIN g a ON a.i = e.i JOIN g b ON b.i = e.j GROUP BY 1) "
    f"SELECT c.cell, c_x, c_y, volume, coalesce(k, 0) AS k, coalesce(k, 0) AS n_steps, {r('coalesce(s_x, 0)', 's_x')}, {r('coalesce(s_y, 0)', 's_y')}, {r('coalesce(s_t, 0)', 's_t', 3)}, n_left, n_right, n_top, n_bottom, CAST(0 AS BIGINT) AS wrong FROM c LEFT JOIN m ON m.cell = c.cell JOIN h ON h.cell = c.cell"
)
def cluster_files(spark, sf):
    """Steps of the grid's cells through a .cluster folder, with the numbers that it states and those that it holds."""
    cells, path = GRID.cells(spark), folder(spark, "cluster")
    moves = on_grid(T.to_translocations(walk(spark, sf))).select("cell", "dx", "dy", "dt")
    clusters.write_cluster(cells.select("cell", "c_x", "c_y", F.lit(1000.0).alias("volume")), clusters.sided(G.grid_edges(spark, 10, 5), cells), moves, path)
    found = clusters.read_cluster(spark, path)
    sums = found.steps.groupBy("cell").agg(F.count("*").alias("n_steps"), *(F.sum(f"d{c}").alias(f"s_{c}") for c in "xyt"))
    sides = found.edges.groupBy(F.col("i").alias("cell")).agg(*(F.count_if(F.col("label") == clusters.SIDES[s.upper()]).alias(f"n_{s}") for s in _SIDES))
    wrong = clusters.mismatches(found).groupBy("cell").agg(F.count("*").alias("wrong"))
    out = found.cells.drop("area").join(sums, "cell", "left").join(sides, "cell", "left").join(wrong, "cell", "left").fillna(0)
    return rounded(out.withColumn("s_t", F.round("s_t", 3)))


@query(
    f"WITH {WALK}, {MOVES}, m AS (SELECT {CELL} AS cell, count(*) AS k, sum(dx) / sum(dt) AS d_x, sum(dy) / sum(dt) AS d_y FROM d WHERE dt > 0 GROUP BY 1) "
    f"SELECT cell, k, (cell // 5 + 0.5) * 50e0 AS c_x, (cell % 5 + 0.5) * 20e0 AS c_y, {r('d_x', 'force_x', 9)}, {r('d_y', 'force_y', 9)}, 'DD' AS mode FROM m"
)
def vmesh_files(spark, sf):
    """A map of mean velocities through a .vmesh folder."""
    moves = on_grid(T.to_translocations(walk(spark, sf))).where("dt > 0")
    sums = I.statistics(moves).join(GRID.cells(spark).select("cell", "c_x", "c_y"), "cell")
    per = F.col("k") * F.col("dt")
    path = folder(spark, "vmesh")
    clusters.write_vmesh(sums.select("cell", "k", "c_x", "c_y", (F.col("m_x") / per).alias("force_x"), (F.col("m_y") / per).alias("force_y")), path, {"Inference Mode": "DD"})
    maps, header = clusters.read_vmesh(spark, path)
    return rounded(maps.withColumn("mode", F.lit(header["Inference Mode"])), 9)
