"""Queries on tessellations: growers, Voronoi cells, graphs of irregular cells, scaling of vectors, the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.functions import columns as C
from stepfield.operators import assign as A
from stepfield.operators import graph as G
from stepfield.operators import roi as R
from stepfield.operators import scaling, voronoi
from stepfield.operators import tessellate as S
from stepfield.plans.common import CELL, CELLS, EDGES, GRID, STEPS, WALK, on_grid, r, rounded, steps, walk
from stepfield.plans.registry import query
from stepfield.sources import catalog, locations
from stepfield.sources.storage import folder

#: The box of the Voronoi queries, and centres: the mean place of each trajectory.
BOX = (0.0, 500.0, 0.0, 100.0)
_CENTRES = "c AS (SELECT n AS cell, round(avg(x), 6) AS c_x, round(avg(y), 6) AS c_y FROM p GROUP BY n)"
#: Each bisector of a centre, and each side of the box, as a line at distance h with all half-planes that cut it.
_CUT = (
    "q AS (SELECT a.cell AS i, b.cell AS j, a.c_x AS x, a.c_y AS y, b.c_x - a.c_x AS nx, b.c_y - a.c_y AS ny, (b.c_x ** 2 + b.c_y ** 2 - a.c_x ** 2 - a.c_y ** 2) / 2 AS b FROM c a JOIN c b ON a.cell <> b.cell "
    "UNION ALL SELECT cell, j, c_x, c_y, nx, ny, b FROM c, (VALUES (-1, 0e0, -1e0, 0e0), (-2, 1e0, 0e0, 500e0), (-3, 0e0, 1e0, 100e0), (-4, -1e0, 0e0, 0e0)) s(j, nx, ny, b)), "
    "l AS (SELECT i, j, (b - nx * x - ny * y) / sqrt(nx * nx + ny * ny) AS h, x + nx * (b - nx * x - ny * y) / (nx * nx + ny * ny) AS px, y + ny * (b - nx * x - ny * y) / (nx * nx + ny * ny) AS py, -ny / sqrt(nx * nx + ny * ny) AS ux, nx / sqrt(nx * nx + ny * ny) AS uy FROM q), "
    "t AS (SELECT l.i, l.j, l.h, q.nx * ux + q.ny * uy AS a, q.b - q.nx * px - q.ny * py AS c FROM l JOIN q ON q.i = l.i AND q.j <> l.j), "
    "v AS (SELECT i, j, any_value(h) AS h, min(c / a) FILTER (a > 1e-12) - max(c / a) FILTER (a < -1e-12) AS ridge FROM t GROUP BY i, j HAVING coalesce(min(c) FILTER (abs(a) <= 1e-12), 0) >= 0 AND ridge > 1e-9) "
)


def _polygons(spark, sf):
    centres = walk(spark, sf).groupBy(F.col("n").alias("cell")).agg(F.round(F.avg("x"), 6).alias("c_x"), F.round(F.avg("y"), 6).alias("c_y"))
    return voronoi.polygons(centres, BOX)


@query(f"WITH {WALK}, {_CENTRES}, {_CUT} SELECT i, j, {r('ridge', digits=4)} FROM v WHERE j >= 0 AND ridge > 1e-4")
def voronoi_edges(spark, sf):
    """Adjacency of trajectories' mean places: cells that share a ridge within the box, and its length."""
    return rounded(voronoi.ridges(_polygons(spark, sf)).where("ridge > 1e-4").select("i", "j", "ridge"), 4)


@query(f"WITH {WALK}, {_CENTRES}, {_CUT} SELECT i AS cell, {r('sum(ridge * h) / 2', 'volume', 4)}, min(j) >= 0 AS closed FROM v GROUP BY i")
def voronoi_volumes(spark, sf):
    """Areas of those cells within the box, and which of them are interior."""
    return rounded(voronoi.volumes(_polygons(spark, sf)), 4)


@query(f"WITH {WALK}, {_CENTRES}, {_CUT}, k AS (SELECT cell, count(*) AS k FROM (SELECT row_id, cell FROM p, c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY (x - c_x) ** 2 + (y - c_y) ** 2, cell) = 1) GROUP BY cell) SELECT i AS cell, {r('any_value(k) / (sum(ridge * h) / 2)', 'density')} FROM v JOIN k ON k.cell = i GROUP BY i")
def voronoi_density(spark, sf):
    """Locations per area of the Voronoi cell that they are in."""
    cells = _polygons(spark, sf)
    k = A.nearest(walk(spark, sf), cells.select("cell", "c_x", "c_y")).groupBy("cell").agg(F.count("*").alias("k"))
    return rounded(k.join(voronoi.volumes(cells), "cell").select("cell", (F.col("k") / F.col("volume")).alias("density")))


@query()
def point_densities(spark, sf):
    """Density at every place from its own Voronoi cell and its neighbours. No SQL: all pairs of places are too many; polygons are tested by brute force."""
    return rounded(voronoi.point_densities(walk(spark, sf), (0.0, 500.0, 0.0, 100.0), 1))


_HEX = "h AS (SELECT CAST(i AS INT) AS cell, (i % 8) * 80e0 + ((i // 8) % 2) * 40e0 AS c_x, (i // 8) * (120e0 / sqrt(3)) AS c_y FROM range(24) r(i))"


_LEVELS, _LEAST, _MOST = 4, 20, 60
_QUAD = (
    f"b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), "
    f"f AS (SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 16)), 15) AS INT) AS i, CAST(least(floor((y - y0) / ((y1 - y0) / 16)), 15) AS INT) AS j FROM p, b), "
    "d AS (SELECT CAST(d AS INT) AS d FROM range(5) r(d)), "
    "k AS (SELECT d, i // (1 << (4 - d)) AS i, j // (1 << (4 - d)) AS j, count(*) AS k FROM f, d GROUP BY ALL), "
    f"s AS (SELECT a.d, a.i, a.j FROM k a JOIN k c ON c.d = a.d + 1 AND c.i // 2 = a.i AND c.j // 2 = a.j WHERE a.k > {_LEAST} GROUP BY ALL HAVING max(c.k) > {_MOST} OR (count(*) = 4 AND min(c.k) > {_LEAST})), "
    "t AS (SELECT 0 AS d, 0 AS i, 0 AS j UNION ALL SELECT t.d + 1, CAST(t.i * 2 + o.a AS INT), CAST(t.j * 2 + o.b AS INT) FROM t JOIN s ON s.d = t.d AND s.i = t.i AND s.j = t.j, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)), "
    "w AS (SELECT t.* FROM t LEFT JOIN s ON s.d = t.d AND s.i = t.i AND s.j = t.j WHERE s.d IS NULL) "
)


@query(f"WITH RECURSIVE {WALK}, {_QUAD} SELECT {r('x0 + (i + 0.5) * (x1 - x0) / (1 << d)', 'c_x')}, {r('y0 + (j + 0.5) * (y1 - y0) / (1 << d)', 'c_y')}, {r('(x1 - x0) * (y1 - y0) / (1 << (2 * d))', 'volume')} FROM w, b")
def quadtree_leaves(spark, sf):
    return rounded(S.quadtree(walk(spark, sf), _LEAST, _MOST, _LEVELS).select("c_x", "c_y", "volume"))


_STARTS = [(50.0, 20.0), (50.0, 80.0), (250.0, 20.0), (250.0, 80.0), (450.0, 20.0), (450.0, 80.0)]


def _lloyd(rounds: int) -> str:
    out = ["k0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x!r}e0, {y!r}e0)" for i, (x, y) in enumerate(_STARTS)) + ") v(cell, c_x, c_y))"]
    out += [f"k{n + 1} AS (SELECT cell, avg(x) AS c_x, avg(y) AS c_y FROM (SELECT row_id, x, y, cell FROM p, k{n} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY (x - c_x) * (x - c_x) + (y - c_y) * (y - c_y), cell) = 1) GROUP BY cell)" for n in range(rounds)]
    return ", ".join(out)


@query(f"WITH {WALK}, {_lloyd(3)} SELECT cell, {r('c_x', digits=4)}, {r('c_y', digits=4)} FROM k3")
def kmeans_centres(spark, sf):
    """Three rounds of Lloyd's iterations from six given centres."""
    return rounded(S.kmeans(walk(spark, sf), _STARTS, rounds=3), 4)


@query(f"WITH {WALK}, {_lloyd(0)} SELECT cell, count(*) AS k FROM (SELECT row_id, cell FROM p, k0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY (x - c_x) * (x - c_x) + (y - c_y) * (y - c_y), cell) = 1) GROUP BY cell")
def custom_centres(spark, sf):
    return A.nearest(walk(spark, sf), S.custom(spark, _STARTS)).groupBy("cell").agg(F.count("*").alias("k"))


def _children(spark, sf):
    """Each grid cell's quarters that hold points."""
    quarter = (F.when(F.col("x") > F.col("c_x"), 2).otherwise(0) + F.when(F.col("y") > F.col("c_y"), 1).otherwise(0)).alias("child")
    return on_grid(walk(spark, sf)).join(F.broadcast(GRID.cells(spark)), "cell").groupBy(F.col("cell").alias("parent"), quarter).agg(F.count("*").alias("k"))


@query(f"WITH {WALK}, {CELLS}, o AS (SELECT c.cell AS parent, CASE WHEN x > c_x THEN 2 ELSE 0 END + CASE WHEN y > c_y THEN 1 ELSE 0 END AS child, count(*) AS k FROM (SELECT x, y, {CELL} AS cell FROM p) p JOIN c ON c.cell = p.cell GROUP BY ALL) SELECT parent, child, k, CAST(row_number() OVER (ORDER BY parent, child) - 1 AS INT) AS cell FROM o")
def nested_cells(spark, sf):
    """Quarters of the grid's cells, numbered across cells."""
    return A.nested(GRID.cells(spark), _children(spark, sf)).select("parent", "child", "k", "cell")


@query(f"WITH {WALK}, a AS (SELECT {CELL} AS cell, count(*) AS k FROM p GROUP BY 1) SELECT count(*) AS cells, sum(k)::BIGINT AS k FROM a WHERE cell % 2 = 0")
def sign_group_sizes(spark, sf):
    """A checkerboard's signs on the grid's diagonal neighbours: one group of even cells."""
    on = on_grid(walk(spark, sf)).groupBy("cell").agg(F.count("*").alias("k"))
    v = GRID.cells(spark).select("cell", F.when(F.col("cell") % 2 == 0, 1.0).otherwise(-1.0).alias("value"))
    groups = G.sign_groups(G.grid_edges(spark, 10, 5, diagonal=True), v)
    return on.join(groups.where("group = 0"), "cell").agg(F.count("*").alias("cells"), F.sum("k").alias("k"))


_SCALE = "z AS (SELECT avg(x) AS ax, avg(y) AS ay, sqrt(greatest(avg((x * x + y * y) / 2) - ((avg(x) + avg(y)) / 2) ** 2, 0)) AS s FROM p)"


@query(f"WITH {STEPS}, {_SCALE} SELECT row_id, {r('x / s', 'x')}, {r('y / s', 'y')}, {r('900 / (s * s)', 'area')} FROM p, z")
def scaled_vectors(spark, sf):
    """Vectors and an area in whitened units: factors only, no centres."""
    df = steps(spark, sf)
    scaler = scaling.whiten(df, ["x", "y"], ["x", "y"])
    return rounded(scaler.scale_vectors(df, ["x", "y"]).select("row_id", "x", "y", F.lit(scaler.scale_size(900.0, 2)).alias("area")))


@query(f"WITH {WALK} SELECT row_id, {r('atan2(y, x)', 'angle')}, {r('sqrt(x * x + y * y)', 'radius', 4)}, {r('atan2(50e0, sqrt(x * x + y * y))', 'elevation')}, {r('greatest(abs(x), abs(y))', 'chebyshev')}, sqrt(x * x + y * y) <= 2 * sqrt(2 * 100e0 * 50) AS within FROM p")
def polar_coordinates(spark, sf):
    """Angles, radii and the largest coordinate of each location; whether a step of it could be a diffusing particle's."""
    angle, radius = C.polar("x", "y")
    df = walk(spark, sf).withColumn("z", F.lit(50.0))
    out = df.select("row_id", angle.alias("angle"), F.round(radius, 4).alias("radius"), C.spherical("x", "y", "z")[1].alias("elevation"), C.chebyshev(["x", "y"]).alias("chebyshev"), (C.euclidean(["x", "y"]) <= C.jump_bound(100.0, 50.0)).alias("within"))
    return rounded(out)


@query(f"WITH {WALK}, f AS (SELECT row_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y FROM p) SELECT row_id, {r('CAST(x AS DOUBLE)', 'x')}, {r('CAST(y AS DOUBLE)', 'y')} FROM f")
def single_precision(spark, sf):
    df = locations.single_precision(walk(spark, sf), ["x", "y"])
    return rounded(df.select("row_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))


@query(f"WITH {WALK} SELECT n, count(*) AS k FROM p WHERE x BETWEEN 90 AND 110 AND y BETWEEN 40 AND 60 OR x BETWEEN 290 AND 310 AND y BETWEEN 10 AND 30 GROUP BY n")
def roi_squares(spark, sf):
    """Locations in any of two squares of side 20, by trajectory."""
    roi = R.squares(spark.createDataFrame([(0, 100.0, 50.0), (1, 300.0, 20.0)], "idx int, x double, y double"), 20.0)
    return R.crop_union(walk(spark, sf), roi).groupBy("n").agg(F.count("*").alias("k"))


@query(f"WITH {WALK} SELECT CAST(1 AS BIGINT) AS n, row_id, {r('sqrt((x - px) ** 2 + (y - py) ** 2)', 'step', 4)} FROM (SELECT *, lag(x) OVER (ORDER BY t, row_id) AS px, lag(y) OVER (ORDER BY t, row_id) AS py FROM p)")
def one_particle_steps(spark, sf):
    """All locations as a single particle's trajectory, with its steps."""
    return rounded(R.steps_in_order(R.one_particle(walk(spark, sf))).select("n", "row_id", "step"), 4)


@query(
    f"WITH {WALK}, k AS (SELECT {CELL} AS cell, count(*) AS k FROM p GROUP BY 1), c AS (SELECT count(*) AS cells, sum(k)::BIGINT AS k FROM k) SELECT * FROM (VALUES "
    "('grid0', 'grid0', 'cells', 'first', FALSE), ('grid1', 'grid1', 'cells', NULL, FALSE), ('grid0/map', 'map', 'maps', 'again', TRUE)) v(path, label, kind, comment, found), c"
)
def catalog_tree(spark, sf):
    """A tree of artefacts: automatic labels, a replaced one, a merged one; the nodes, which of them is a map below grid0, and what map() reads back."""
    counts = on_grid(walk(spark, sf)).groupBy("cell").agg(F.count("*").alias("k"))
    own, other = catalog.Catalog(spark, folder(spark, "catalog")), catalog.Catalog(spark, folder(spark, "catalog"))
    own.add(counts, "grid*", kind="cells", comment="first")
    own.add(counts.limit(0), "map", "grid0", "maps")
    own.add(counts, "map", "grid0", "maps", "again")
    other.add(counts.limit(0), "grid0", kind="cells")
    other.add(counts, "grid1", kind="cells")
    own.merge(other)
    read = own.map(lambda path, df: df.agg(F.lit(path).alias("path"), F.count("*").alias("cells"), F.sum("k").alias("k")))
    rows = None
    for df in read.values():
        rows = df if rows is None else rows.unionByName(df)
    found = F.col("path") == F.lit(own.find("grid0/map", "maps"))
    nodes = own.subtree("grid0").unionByName(own.subtree("grid1")).select("path", "label", F.col("type").alias("kind"), "comment", found.alias("found"))
    return nodes.join(rows, "path")
