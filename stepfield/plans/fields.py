"""Queries on fields of cells of any shape, on the choice of neighbours, on ergodicity and spectra, on linked locations and region files."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stepfield.operators import assign as A
from stepfield.operators import derive as V
from stepfield.operators import features as X
from stepfield.operators import graph as G
from stepfield.operators import infer as I
from stepfield.operators import roi as R
from stepfield.operators import tessellate as S
from stepfield.operators import trajectory as T
from stepfield.operators.boxes import points_in_boxes
from stepfield.plans.common import CELL, CELLS, GRID, STEPS, WALK, W, on_grid, r, rounded, steps, walk
from stepfield.plans.registry import ORACLE, query
from stepfield.sources import locations
from stepfield.sources.storage import folder

_HEX = "h AS (SELECT CAST(i AS INT) AS cell, (i % 8) * 80e0 + ((i // 8) % 2) * 40e0 AS c_x, (i // 8) * (120e0 / sqrt(3)) AS c_y FROM range(24) r(i))"
_HEX_MAP = (
    f"WITH {WALK}, {_HEX}, e AS (SELECT a.cell AS i, b.cell AS j FROM h a JOIN h b ON a.cell <> b.cell AND abs(sqrt((a.c_x - b.c_x) ** 2 + (a.c_y - b.c_y) ** 2) - 80) < 1e-6), "
    "m AS (SELECT cell, avg(y) AS fx, avg(x) AS fy FROM (SELECT row_id, cell, x, y FROM p, h QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY (x - c_x) * (x - c_x) + (y - c_y) * (y - c_y), cell) = 1) GROUP BY cell), "
    "n AS (SELECT e.i, e.j, b.c_x AS jx, b.c_y AS jy, atan2(b.c_y - a.c_y, b.c_x - a.c_x) AS turn FROM e JOIN h a ON a.cell = e.i JOIN h b ON b.cell = e.j), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY turn) - 1 AS q, count(*) OVER (PARTITION BY i) AS size FROM n), "
    "g AS (SELECT o.i, o.j, o.size, b.j AS nxt, (b.jx - a.jx) / 2 AS tx, (b.jy - a.jy) / 2 AS ty FROM o JOIN o b ON b.i = o.i AND b.q = (o.q + 1) % o.size JOIN o a ON a.i = o.i AND a.q = (o.q + o.size - 1) % o.size WHERE o.size > 2), "
    "c AS (SELECT g.i FROM g JOIN e ON e.i = g.j AND e.j = g.nxt GROUP BY g.i HAVING count(*) = any_value(g.size)), k AS (SELECT g.* FROM g JOIN c ON c.i = g.i) "
)


def _hex_map(spark, sf):
    cells = S.hexagons(spark, 0.0, 0.0, 500.0, 100.0, 40.0)
    field = A.nearest(walk(spark, sf), cells.select("cell", "c_x", "c_y")).groupBy("cell").agg(F.avg("y").alias("fx"), F.avg("x").alias("fy"))
    return cells.join(field, "cell", "left"), G.hexagon_edges(cells)


@query(_HEX_MAP + f"SELECT i AS cell, j, {r('tx', digits=4)}, {r('ty', digits=4)} FROM k")
def hexagon_rings(spark, sf):
    """Closed rings of neighbours of hexagons, with their tangents."""
    return rounded(V.rings(*_hex_map(spark, sf)), 4)


@query(_HEX_MAP + f"SELECT i AS cell, {r('coalesce(sum(fx * tx + fy * ty), 0) / (2 * sqrt(3) * 1600)', 'curl', 4)} FROM k LEFT JOIN m ON m.cell = k.j GROUP BY i")
def hexagon_curl(spark, sf):
    """Curl of mean places along the rings of hexagons."""
    return rounded(V.ring_curl(*_hex_map(spark, sf), "fx", "fy"), 4)


_EIGHT = "g AS (SELECT CAST(i AS INT) AS i, i // 5 AS gx, i % 5 AS gy FROM range(50) r(i)), e AS (SELECT a.i, b.i AS j FROM g a JOIN g b ON greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1)"
_FIELD = f"m AS (SELECT {CELL} AS cell, avg(x) + avg(y) AS value FROM p GROUP BY 1)"


def _cone(a: str) -> str:
    u = f"1 - acos((j{a} - i{a}) / sqrt((jx - ix) ** 2 + (jy - iy) ** 2)) * 2 / pi()"
    return f"avg(j{a}) FILTER ({u} < -0.5) AS {a}u, avg(jv) FILTER ({u} < -0.5) AS {a}yu, avg(j{a}) FILTER ({u} > 0.5) AS {a}v, avg(jv) FILTER ({u} > 0.5) AS {a}yv"


def _parabola(a: str) -> str:
    u, v = f"((iv - {a}yu) / (i{a} - {a}u))", f"(({a}yv - iv) / ({a}v - i{a}))"
    return f"CASE WHEN {a}u IS NOT NULL AND {a}v IS NOT NULL THEN ({u} * ({a}v - i{a}) + {v} * (i{a} - {a}u)) / ({a}v - {a}u) WHEN {a}u IS NOT NULL THEN {u} ELSE {v} END"


@query(
    f"WITH {WALK}, {CELLS}, {_EIGHT}, {_FIELD}, v AS (SELECT c.cell, c_x, c_y, value FROM c JOIN m ON m.cell = c.cell), "
    f"n AS (SELECT e.i, a.c_x AS ix, a.c_y AS iy, a.value AS iv, b.c_x AS jx, b.c_y AS jy, b.value AS jv FROM e JOIN v a ON a.cell = e.i JOIN v b ON b.cell = e.j), "
    f"y AS (SELECT i, ix, iy, iv, {_cone('x')}, {_cone('y')} FROM n GROUP BY ALL) SELECT i AS cell, {r(_parabola('x'), 'grad_x')}, {r(_parabola('y'), 'grad_y')} FROM y"
)
def gradient_by_angle(spark, sf):
    """Gradient over eight neighbours, of which those within a quarter turn about an axis count: on flat cells the diagonal ones count for x alone."""
    value = on_grid(walk(spark, sf)).groupBy("cell").agg((F.avg("x") + F.avg("y")).alias("value"))
    return rounded(V.gradient(GRID.cells(spark).join(value, "cell"), G.grid_edges(spark, 10, 5, diagonal=True), "value", **V.gradient_options(angle=0.5)))


def _phases(name: str, source: str, omega: str) -> str:
    """SQL: (n, cx, sx, cy, sy) over the lags of rows (n, i, last, x, y)."""
    parts = [f"{f}({omega} * (b.{a} - a.{a}))" for a in "xy" for f in ("cos", "sin")]
    return (
        f"{name}_l AS (SELECT DISTINCT n, CASE WHEN least(last + 1, 7) > 1 THEN 1 + (k * (last - 1)) // (least(last + 1, 7) - 1) ELSE 1 END AS lag FROM (SELECT DISTINCT n, last FROM {source} WHERE last > 0), range(7) t(k) WHERE k < least(last + 1, 7)), "
        f"{name}_g AS (SELECT a.n, lag, avg({parts[0]}) AS cx, avg({parts[1]}) AS sx, avg({parts[2]}) AS cy, avg({parts[3]}) AS sy FROM {source} a JOIN {name}_l l ON l.n = a.n JOIN {source} b ON b.n = a.n AND b.i = a.i + lag GROUP BY a.n, lag), "
        f"{name} AS (SELECT n, avg(cx) AS cx, avg(sx) AS sx, avg(cy) AS cy, avg(sy) AS sy FROM {name}_g GROUP BY n)"
    )


_BREAKING = (
    f"WITH {STEPS}, z AS (SELECT n, x, y, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY n) AS size, lead(x) OVER {W} - x AS dx, lead(y) OVER {W} - y AS dy, first_value(x) OVER {W} AS x0, first_value(y) OVER {W} AS y0 FROM p), "
    "a1 AS (SELECT n, i, size - 2 AS last, dx / CASE WHEN rx < 1e-8 THEN 1 ELSE rx END AS x, dy / CASE WHEN ry < 1e-8 THEN 1 ELSE ry END AS y FROM (SELECT *, sqrt(avg(dx * dx) OVER (PARTITION BY n)) AS rx, sqrt(avg(dy * dy) OVER (PARTITION BY n)) AS ry FROM z) WHERE dx IS NOT NULL), "
    "a2 AS (SELECT n, i, size - 1 AS last, x, y FROM z WHERE size > 1), "
    "q1 AS (SELECT n, avg(cos(x)) ** 2 + avg(sin(x)) ** 2 AS qx, avg(cos(y)) ** 2 + avg(sin(y)) ** 2 AS qy FROM a1 GROUP BY n), "
    "q2 AS (SELECT n, count(*) AS k, avg(cos(2 * (x - x0))) ** 2 + avg(sin(2 * (x - x0))) ** 2 AS qx, avg(cos(2 * (y - y0))) ** 2 + avg(sin(2 * (y - y0))) ** 2 AS qy FROM z WHERE size > 1 GROUP BY n), "
    f"{_phases('f1', 'a1', '1')}, {_phases('f2', 'a2', '2')} "
)


@query(
    _BREAKING + "SELECT q2.n, " + ", ".join(r(f"sqrt((f1.c{a} - q1.q{a}) ** 2 + f1.s{a} ** 2)", f"ergo_{a}") + ", " + r(f"sqrt((f2.c{a} + 1e0 / k - q2.q{a} / (k * (k + 1))) ** 2 + f2.s{a} ** 2)", f"ergo2_{a}") for a in "xy")
    + " FROM q2 JOIN f2 ON f2.n = q2.n LEFT JOIN q1 ON q1.n = q2.n LEFT JOIN f1 ON f1.n = q2.n"
)
def ergodicity_breaking(spark, sf):
    return rounded(X.ergodicity_breaking(steps(spark, sf)))


@query(
    f"WITH {WALK}, c AS (SELECT n, x AS qx, y AS qy, row_number() OVER (PARTITION BY n ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS q FROM p QUALIFY q <= 30), d AS (SELECT p.n, q, sqrt((x - qx) ** 2 + (y - qy) ** 2) AS d FROM p JOIN c ON c.n = p.n), "
    "t AS (SELECT n, least(max(d), 200e0) AS top FROM d GROUP BY n HAVING max(d) > 0), z AS (SELECT d.n, q, k, top * 4e0 ** (k / 19e0 - 1) AS r, count(*) FILTER (d < top * 4e0 ** (k / 19e0 - 1)) / count(*) AS z FROM d JOIN t ON t.n = d.n, range(20) t(k) GROUP BY d.n, q, k, top), "
    f"s AS (SELECT n, r, ln(r) / 0.5 * ln(avg(z ** 0.5)) AS hi, ln(r) / -2.5 * ln(avg(z ** -2.5)) AS lo FROM z WHERE r <> 1 GROUP BY n, r) SELECT n, {r('(regr_intercept(hi, r) - regr_intercept(lo, r)) / 3', 'frac_slope', 4)} FROM s GROUP BY n"
)
def fractal_slope(spark, sf):
    return rounded(X.fractal_slope(walk(spark, sf), largest=200.0), 4)


@query(f"WITH {WALK}, l AS ({ORACLE['mutual_links']}) SELECT l.a, CAST(floor(s.t / 86400e0) AS BIGINT) AS frame, {r('s.x', 'x')}, {r('s.y', 'y')}, {r('e.x - s.x', 'dx')}, {r('e.y - s.y', 'dy')} FROM l JOIN p s ON s.row_id = l.a JOIN p e ON e.row_id = l.b")
def link_displacements(spark, sf):
    """Displacements of the mutual links between days, without trajectories."""
    df = walk(spark, sf).withColumn("frame", F.floor(F.col("t") / 86400.0))
    return rounded(R.link_displacements(df, R.mutual_next_frame_links(df, 10.0)))


@query(f"WITH {WALK}, a AS (SELECT row_id, x, {CELL} AS cell FROM p) SELECT row_id, cell FROM a WHERE cell IN (SELECT cell FROM a GROUP BY cell HAVING max(x) - min(x) > 49 AND count(*) % 2 = 1)")
def cells_by_predicate(spark, sf):
    """Locations of cells that hold an odd number of them, spread over nearly the whole width."""
    return A.where_cells(on_grid(walk(spark, sf)), (F.max("x") - F.min("x") > 49) & (F.count("*") % 2 == 1)).select("row_id", "cell")


@query(
    f"WITH {WALK}, s AS (SELECT avg(sqrt(dx * dx + dy * dy)) AS s FROM (SELECT x - lag(x) OVER {W} AS dx, y - lag(y) OVER {W} AS dy FROM p)), k AS (SELECT count(*) AS k FROM p) "
    f"SELECT {r('0.8 * s', 'min_distance', 4)}, {r('2 * s', 'avg_distance', 4)}, CAST(20 AS BIGINT) AS min_location_count, CAST(80 AS BIGINT) AS avg_location_count, {r('20e0 / k', 'min_probability', 4)}, {r('80e0 / k', 'avg_probability', 4)} FROM s, k"
)
def grower_parameters(spark, sf):
    """Default lengths and counts of the growers, from the mean step and the number of locations."""
    df = walk(spark, sf)
    return rounded(spark.createDataFrame([S.parameters(T.mean_step(df).first()["mean_step"], df.count())]), 4)


@query(f"WITH {WALK}, s AS (SELECT n, t, sqrt((x - lag(x) OVER {W}) ** 2 + (y - lag(y) OVER {W}) ** 2) AS step FROM p) SELECT n, {r('max(step) / sqrt(max(t) - min(t))', 'step_max')} FROM s GROUP BY n HAVING count(*) > 1 AND max(t) > min(t)")
def features_per_duration(spark, sf):
    """The longest step over the root of the duration."""
    df = walk(spark, sf)
    both = X.step_moments(df).join(X.spans(df).where("t_max > t_min"), "n")
    return rounded(X.per_duration(both, ["step_max"], root=True).select("n", "step_max"))


@query(f"WITH {WALK} SELECT row_id, {r('t * 0.04', 't', 4)}, {r('x * 0.16', 'x')}, {r('y * 0.16', 'y')} FROM p")
def frames_scaled(spark, sf):
    """Frame numbers to seconds, pixels to lengths."""
    return rounded(locations.scaled_frames(walk(spark, sf), 0.04, 0.16).select("row_id", F.round("t", 4).alias("t"), "x", "y"))


@query(f"WITH {WALK}, b AS (SELECT (i % 6) * 70e0 AS x_min, (i % 6) * 70e0 + 80e0 AS x_max, (i // 6) * 30e0 AS y_min, (i // 6) * 30e0 + 25e0 AS y_max FROM range(18) r(i)) SELECT x_min, y_min, count(*) AS k FROM p JOIN b ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max GROUP BY x_min, y_min")
def roi_files(spark, sf):
    """Regions written as text and read again, with the number of locations in each."""
    i, path = F.col("id"), folder(spark, "roi")
    boxes = spark.range(18).select(((i % 6) * 70.0).alias("x_min"), ((i % 6) * 70.0 + 80.0).alias("x_max"), (F.floor(i / 6) * 30.0).alias("y_min"), (F.floor(i / 6) * 30.0 + 25.0).alias("y_max"))
    locations.write_roi(boxes, path)
    kept = [F.col(c).cast("double").alias(c) for c in ("x_min", "x_max", "y_min", "y_max")]
    return points_in_boxes(walk(spark, sf), locations.read_roi(spark, path).select(*kept), ["x_min", "y_min"]).groupBy("x_min", "y_min").agg(F.count("*").alias("k"))


_PARTS = ("step_length_stats", "msd_fit", "drift_norm", "gyration_shape", "efficiency_straightness", "axis_kurtosis", "angle_features", "gaussianity_features", "ergodicity", "escape_distances", "displacement_fit", "convex_hull", "ergodicity_breaking", "fractal_slope")
_SPANS = f"SELECT n, count(*) AS size, 0e0 AS t_min, count(*) - 1e0 AS t_max, 1e0 AS dt, TRUE AS is_dt_constant FROM (WITH {WALK} SELECT n FROM p) GROUP BY n"
#: Digits of features that are large or come from parts rounded so; six otherwise.
_DIGITS = dict.fromkeys(("step_mean", "step_skewness", "step_kurtosis", "step_min", "step_max", "drift_norm", "axis_kurtosis", "escape_q1", "escape_median", "escape_q3", "hull_area", "hull_perimeter", "hull_diameter", "frac_slope"), 4) | dict.fromkeys(("l1", "l2", "msd_diffusion"), 3) | {"step_var": 2}


@query(f"SELECT * FROM ({_SPANS}) " + " ".join(f"LEFT JOIN ({ORACLE[part]}) USING (n)" for part in _PARTS) + f" LEFT JOIN (SELECT * EXCLUDE (step_var) FROM ({ORACLE['step_autocorr']})) USING (n)")
def all_features(spark, sf):
    out = X.all_features(steps(spark, sf), largest=200.0)
    return rounded(out.withColumns({c: F.round(c, d) for c, d in _DIGITS.items()}))


_SHAPE = ("gyration_shape", "efficiency_straightness", "axis_kurtosis", "convex_hull")


@query(f"SELECT * FROM ({ORACLE[_SHAPE[0]]}) " + " ".join(f"LEFT JOIN ({ORACLE[part]}) USING (n)" for part in _SHAPE[1:]))
def shape_features(spark, sf):
    out = X.shape_features(walk(spark, sf))
    return rounded(out.withColumns({c: F.round(c, d) for c, d in _DIGITS.items() if c in out.columns}))


_WINDOW = "v AS (SELECT n, CAST(row_number() OVER (PARTITION BY n ORDER BY t, row_id) - 1 AS INT) AS start, CAST(count(*) OVER (PARTITION BY n) AS INT) AS size, avg(step) OVER (PARTITION BY n ORDER BY t, row_id ROWS BETWEEN 1 FOLLOWING AND {after} FOLLOWING) AS step_mean FROM s)"
_STEPPED = f"s AS (SELECT *, sqrt((x - lag(x) OVER {W}) ** 2 + (y - lag(y) OVER {W}) ** 2) AS step FROM p)"


def _mean_step(df):
    return X.step_moments(df).select("n", "step_mean")


@query(
    f"WITH {STEPS}, {_STEPPED}, {_WINDOW.format(after=6)}, m AS (SELECT * FROM v WHERE start < size - 7) SELECT n, i, {r('step_mean', digits=4)} FROM (SELECT n, unnest(range(CASE WHEN start = 0 THEN 0 ELSE start + 3 END, CASE WHEN start = size - 8 THEN size ELSE start + 4 END))::INT AS i, step_mean FROM m)"
)
def feature_vector(spark, sf):
    """Mean steps of windows of seven rows, at every row."""
    return rounded(X.feature_vector(steps(spark, sf), _mean_step, 7), 4)


@query(
    f"WITH {STEPS}, {_STEPPED}, w AS (SELECT n, avg(step) AS whole FROM s GROUP BY n) "
    + " UNION ALL ".join(f"SELECT n, {k} AS rows, {r('avg(step_mean) / nullif(any_value(whole), 0)', 'step_mean')} FROM ({'WITH ' + _WINDOW.format(after=k - 1)} SELECT * FROM v) JOIN w USING (n) WHERE start < size - {k} GROUP BY n" for k in (3, 9, 27))
)
def feature_by_scale(spark, sf):
    """Mean steps of windows of 3, 9 and 27 rows over those of whole trajectories."""
    return rounded(X.mean_by_scale(steps(spark, sf), _mean_step, [3, 9, 27]))
