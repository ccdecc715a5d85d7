"""Queries on maps: inference, derivatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.operators import assign as A
from stepfield.operators import derive as V
from stepfield.operators import graph as G
from stepfield.operators import infer as I
from stepfield.operators import trajectory as T
from stepfield.operators.tessellate import Grid
from stepfield.plans.common import CELL, CELLS, EDGES, GRID, MOVES, STEPS, WALK, on_grid, r, rounded, steps, walk
from stepfield.plans.registry import query

_STATS = f"m AS (SELECT {CELL} AS cell, count(*) AS k, sum(dx * dx + dy * dy) AS s, sum(dx) AS mx, sum(dy) AS my, avg(dt) AS dt, max(dt) AS dt_max FROM d GROUP BY 1)"
_BASE = f"WITH {STEPS}, {MOVES}, {_STATS} "
_R = "(s - (mx * mx + my * my) / k)"


def _bound(d: str) -> str:
    return f"greatest({d}, (1e-16 - 9e-4) / dt_max)"


def _moves(spark, sf):
    return on_grid(T.to_translocations(steps(spark, sf)))


@query(f"WITH {WALK}, {MOVES}, {_STATS} SELECT cell, k, {r('(s / (4e0 * k) - 9e-4) / dt', 'diffusivity', 9)} FROM m WHERE k >= 5")
def map_diffusivity(spark, sf):
    """The flagship: irregular events, steps, grid cells, counts, diffusivity of the mean time step."""
    moves = on_grid(T.to_translocations(walk(spark, sf))).where("dt > 0")
    d = I.statistics(moves).where("k >= 5").select("cell", "k", ((F.col("s") / (4.0 * F.col("k")) - I.SIGMA2) / F.col("dt")).alias("diffusivity"))
    return rounded(d, 9)


@query(_BASE + f"SELECT cell, k, {r(_bound('(s / (4e0 * k) - 9e-4) / dt'), 'diffusivity', 3)} FROM m")
def infer_d(spark, sf):
    return rounded(I.infer_d(_moves(spark, sf)).select("cell", "k", "diffusivity"), 3)


@query(_BASE + f"SELECT cell, k, {r(_bound('(s / (4e0 * (k + 2)) - 9e-4) / dt'), 'diffusivity', 3)} FROM m")
def infer_d_jeffreys(spark, sf):
    return rounded(I.infer_d(_moves(spark, sf), jeffreys=True).select("cell", "k", "diffusivity"), 3)


@query(_BASE + f"SELECT cell, {r(_bound(f'({_R} / (4e0 * k) - 9e-4) / dt'), 'diffusivity', 3)}, {r('mx / (k * dt)', 'drift_x', 4)}, {r('my / (k * dt)', 'drift_y', 4)} FROM m WHERE k > 1")
def infer_dd(spark, sf):
    return rounded(I.infer_dd(_moves(spark, sf)).where("k > 1").select("cell", F.round("diffusivity", 3).alias("diffusivity"), F.round("drift_x", 4).alias("drift_x"), F.round("drift_y", 4).alias("drift_y")))


@query(_BASE + f", x AS (SELECT *, {_bound(f'({_R} / (4e0 * k) - 9e-4) / dt')} AS df FROM m WHERE k > 1) SELECT cell, {r('df', 'diffusivity', 3)}, {r('mx / (k * dt * df)', 'force_x', 9)}, {r('my / (k * dt * df)', 'force_y', 9)} FROM x")
def infer_df(spark, sf):
    return rounded(I.infer_df(_moves(spark, sf)).where("k > 1").select("cell", F.round("diffusivity", 3).alias("diffusivity"), "force_x", "force_y"), 9)


@query(
    _BASE + f", b AS (SELECT *, (k + 2) * 9e-4 + {_R} / 4 AS b FROM m WHERE k > 1), x AS (SELECT *, {_bound(f'((b + sqrt(greatest(b * b - k * {_R} * 9e-4, 0))) / (2 * k) - 9e-4) / dt')} AS df FROM b) "
    f"SELECT cell, {r('df', 'diffusivity', 3)} FROM x"
)
def infer_df_jeffreys(spark, sf):
    return rounded(I.infer_df(_moves(spark, sf), jeffreys=True).where("k > 1").select("cell", "diffusivity"), 3)


@query(
    f"WITH {WALK}, {MOVES}, s AS (SELECT *, CAST(floor((t - 1704067200e0) / 604800e0) AS INT) AS seg FROM d), m AS (SELECT seg, {CELL} AS cell, count(*) AS k, sum(dx * dx + dy * dy) AS s, avg(dt) AS dt, max(dt) AS dt_max FROM s GROUP BY ALL) "
    f"SELECT seg, cell, k, {r(_bound('(s / (4e0 * k) - 9e-4) / dt'), 'diffusivity', 9)} FROM m"
)
def infer_d_by_week(spark, sf):
    """Diffusivity by week, over all weeks from the first Monday of 2024 on that hold steps."""
    moves, start, week = on_grid(T.to_translocations(walk(spark, sf))), 1704067200.0, 604800.0
    last = moves.agg(F.max("t")).first()[0] or start
    moves = A.windows(moves, start, start + week * (1 + (last - start) // week), week)
    return rounded(I.infer_d(moves, I.SIGMA2, False, "seg", "cell").select("seg", "cell", "k", "diffusivity"), 9)


_SNR = (
    f"WITH {STEPS}, {MOVES}, m AS (SELECT {CELL} AS cell, count(*) AS k, sum(dx) AS mx, sum(dy) AS my, sum(dx * dx + dy * dy) AS s FROM d GROUP BY 1), "
    "o AS (SELECT *, (s - (mx * mx + my * my) / k) / k AS v, sum(k) OVER () - k AS ok, sum(mx) OVER () - mx AS ox, sum(my) OVER () - my AS oy, sum(s) OVER () - s AS os FROM m), "
    "q AS (SELECT *, (os - (ox * ox + oy * oy) / ok) / ok AS pv, CASE WHEN k > 1 AND v > 0 THEN mx / k / sqrt(v) END AS zx, CASE WHEN k > 1 AND v > 0 THEN my / k / sqrt(v) END AS zy FROM o) "
)


@query(_SNR + f"SELECT cell, k, {r('v', 'variance', 3)}, {r('pv', 'prior_variance', 3)}, {r('zx', 'zeta_x')}, {r('zy', 'zeta_y')} FROM q WHERE k > 1")
def snr_maps(spark, sf):
    m = I.snr(_moves(spark, sf)).where("k > 1")
    return rounded(m.select("cell", "k", F.round("variance", 3).alias("variance"), F.round("prior_variance", 3).alias("prior_variance"), "zeta_x", "zeta_y"))


@query(_SNR + f"SELECT cell, {r('k * v * (1 + 3e0 / k * pv / v + 3e0 / (k + 3) * (zx * zx + zy * zy)) / (4 * (k + 2))', 'map_diffusivity', 3)} FROM q WHERE k > 1")
def conjugate_diffusivity(spark, sf):
    return rounded(I.conjugate_map(I.snr(_moves(spark, sf)).where("k > 1"), 1.0).select("cell", "map_diffusivity"), 3)


_MAP = f"v AS (SELECT c.cell, c_x, c_y, volume, value FROM c JOIN (SELECT {CELL} AS cell, avg(x) + avg(y) AS value FROM p GROUP BY 1) a ON a.cell = c.cell)"
_NEAR = "x AS (SELECT a.cell, a.c_x, a.c_y, a.value, a.volume, b.cell AS j, b.c_x AS jx, b.c_y AS jy, b.value AS jv FROM e JOIN v a ON a.cell = e.i JOIN v b ON b.cell = e.j)"
_SIDES = (
    "y AS (SELECT cell, c_x, c_y, value, volume, avg(jx) FILTER (jx < c_x - 1e-9) AS xu, avg(jv) FILTER (jx < c_x - 1e-9) AS xyu, avg(jx) FILTER (jx > c_x + 1e-9) AS xv, avg(jv) FILTER (jx > c_x + 1e-9) AS xyv, "
    "avg(jy) FILTER (jy < c_y - 1e-9) AS yu, avg(jv) FILTER (jy < c_y - 1e-9) AS yyu, avg(jy) FILTER (jy > c_y + 1e-9) AS yv, avg(jv) FILTER (jy > c_y + 1e-9) AS yyv FROM x GROUP BY ALL)"
)


def _slope(a: str) -> str:
    u, v = f"((value - {a}yu) / (c_{a} - {a}u))", f"(({a}yv - value) / ({a}v - c_{a}))"
    return f"CASE WHEN {a}u IS NOT NULL AND {a}v IS NOT NULL THEN ({u} * ({a}v - c_{a}) + {v} * (c_{a} - {a}u)) / ({a}v - {a}u) WHEN {a}u IS NOT NULL THEN {u} ELSE {v} END"


_DERIVE = f"WITH {WALK}, {CELLS}, {EDGES}, {_MAP}, {_NEAR}, {_SIDES} "


def _map(spark, sf):
    value = on_grid(walk(spark, sf)).groupBy("cell").agg((F.avg("x") + F.avg("y")).alias("value"))
    return GRID.cells(spark).join(value, "cell"), G.grid_edges(spark, 10, 5)


@query(_DERIVE + f"SELECT cell, {r(_slope('x'), 'grad_x')}, {r(_slope('y'), 'grad_y')} FROM y")
def grad1(spark, sf):
    return rounded(V.gradient(*_map(spark, sf), "value"))


@query(_DERIVE + ", ".join(["SELECT cell", *(f"{r(f'coalesce((value - {a}yu) / (c_{a} - {a}u), 0)', f'below_{a}')}, {r(f'coalesce(({a}yv - value) / ({a}v - c_{a}), 0)', f'above_{a}')}" for a in ("x", "y"))]) + " FROM y")
def delta1(spark, sf):
    return rounded(V.one_sided(*_map(spark, sf), "value"))


@query(_DERIVE + f"SELECT cell AS i, j, {r('(jv - value) / sqrt((jx - c_x) ** 2 + (jy - c_y) ** 2) / sqrt(count(*) OVER (PARTITION BY cell))', 'delta')} FROM x")
def delta0(spark, sf):
    return rounded(V.variations(*_map(spark, sf), "value"))


@query(_DERIVE + f"SELECT cell AS i, j, {r('(jv - value) / sqrt((jx - c_x) ** 2 + (jy - c_y) ** 2)', 'delta')} FROM x")
def delta0_unscaled(spark, sf):
    return rounded(V.variations(*_map(spark, sf), "value", scaled=False))


@query(_DERIVE + f", z AS (SELECT cell, volume, {_slope('x')} AS gx, {_slope('y')} AS gy FROM y) SELECT cell, {r('volume * (coalesce(gx * gx, 0) + coalesce(gy * gy, 0))', 'penalty', 4)} FROM z")
def grad_sum(spark, sf):
    m, e = _map(spark, sf)
    return rounded(V.gradient_sum(V.gradient(m, e, "value"), m), 4)


_TIME = (
    f"WITH {WALK}, a AS (SELECT {CELL} AS cell, CAST(floor((t - 1704067200e0) / 86400e0) AS INT) AS seg, avg(x) AS value FROM p GROUP BY ALL), "
    "b AS (SELECT *, seg + 0.5 AS mid, lag(seg) OVER w AS ps, lead(seg) OVER w AS ns, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM a WINDOW w AS (PARTITION BY cell ORDER BY seg)), "
    "k AS (SELECT *, CASE WHEN ps = seg - 1 THEN value - pv END AS su, CASE WHEN ns = seg + 1 THEN nv - value END AS sv FROM b) "
)


def _by_day(spark, sf):
    df = on_grid(walk(spark, sf)).withColumn("seg", F.floor((F.col("t") - 1704067200.0) / 86400.0).cast("int"))
    return df.groupBy("cell", "seg").agg(F.avg("x").alias("value")).withColumn("mid", F.col("seg") + 0.5)


@query(_TIME + f"SELECT cell, seg, {r('CASE WHEN su IS NOT NULL AND sv IS NOT NULL THEN (su + sv) / 2 ELSE coalesce(su, sv) END', 'dv_dt')} FROM k")
def time_derivative(spark, sf):
    return rounded(V.time_derivative(_by_day(spark, sf), "value").select("cell", "seg", "dv_dt"))


@query(_TIME + f"SELECT cell, seg, {r('coalesce(su, 0)', 'slope_before')}, {r('coalesce(sv, 0)', 'slope_after')} FROM k")
def time_variation(spark, sf):
    return rounded(V.time_variation(_by_day(spark, sf), "value").select("cell", "seg", "slope_before", "slope_after"))


_RING = (
    "o AS (SELECT * FROM (VALUES (-1,-1,1e0,-1e0),(0,-1,2e0,0e0),(1,-1,1e0,1e0),(1,0,0e0,2e0),(1,1,-1e0,1e0),(0,1,-2e0,0e0),(-1,1,-1e0,-1e0),(-1,0,0e0,-2e0)) v(a, b, sx, sy)), "
)


@query(
    f"WITH {STEPS}, {MOVES}, {_RING} f AS (SELECT {CELL} AS cell, avg(dx) AS fx, avg(dy) AS fy FROM d GROUP BY 1) "
    f"SELECT a.cell, {r('sum(f.fx * o.sx * 25 + f.fy * o.sy * 10) / 4000', 'curl', 6)} FROM f a, o JOIN f ON f.cell = (a.cell // 5 + o.a) * 5 + a.cell % 5 + o.b WHERE a.cell // 5 + o.a BETWEEN 0 AND 9 AND a.cell % 5 + o.b BETWEEN 0 AND 4 GROUP BY a.cell HAVING count(*) = 8"
)
def grid_curl(spark, sf):
    field = _moves(spark, sf).groupBy("cell").agg(F.avg("dx").alias("fx"), F.avg("dy").alias("fy"))
    return rounded(V.grid_curl(field, 10, 5, "fx", "fy", 50.0, 20.0))


@query(
    f"WITH {WALK}, {CELLS}, {EDGES}, k AS (SELECT c.cell, c_x, c_y, count(q.cell) AS k FROM c LEFT JOIN (SELECT {CELL} AS cell FROM p) q ON q.cell = c.cell GROUP BY ALL), "
    "b AS (SELECT e.i, e.j FROM e JOIN k a ON a.cell = e.i JOIN k b ON b.cell = e.j WHERE a.k < 220 AND b.k >= 220 QUALIFY row_number() OVER (PARTITION BY e.i ORDER BY sqrt((a.c_x - b.c_x) ** 2 + (a.c_y - b.c_y) ** 2), e.j) = 1) "
    "SELECT c.cell, coalesce(b.j, c.cell) AS target FROM c LEFT JOIN b ON b.i = c.cell"
)
def merge_small_cells(spark, sf):
    cells = GRID.cells(spark)
    return I.merge_small(A.counts(on_grid(walk(spark, sf)), cells), cells, G.grid_edges(spark, 10, 5), 220)


@query()
def infer_d_any_dt(spark, sf):
    """Irregular durations: the numerical optimum of each cell."""
    return rounded(I.infer_any_dt(on_grid(T.to_translocations(walk(spark, sf))).where("dt > 0"), "dd").select("cell", "k", "diffusivity", "a_x", "a_y"), 9)


@query()
def smooth_diffusivity(spark, sf):
    """Joint map of diffusivity and drift under a smoothness prior; tested by the slope of the whole cost, which must vanish."""
    cells = I.statistics(_moves(spark, sf)).where("k > 1").join(GRID.cells(spark), "cell")
    return rounded(I.smooth_joined(cells, G.grid_edges(spark, 10, 5), 5e-10, "dd"), 3)


def _quadratic(a: str) -> str:
    """On a grid the axes separate: two neighbours settle slope and curvature; with one, the least norm of both does."""
    d, near = f"(j{a} - c_{a})", f"FILTER (abs(j{a} - c_{a}) > 1e-9)"
    return f"coalesce(sum((jv - value) * {d}) {near} / CASE count(*) {near} WHEN 2 THEN sum({d} ** 2) {near} ELSE sum({d} ** 2 + {d} ** 4) {near} END, 0)"


@query(f"WITH {WALK}, {CELLS}, {EDGES}, {_MAP}, {_NEAR} SELECT cell, {r(_quadratic('x'), 'grad_x')}, {r(_quadratic('y'), 'grad_y')} FROM x GROUP BY cell")
def quadratic_gradient(spark, sf):
    return rounded(V.quadratic_gradient(*_map(spark, sf), "value"))


@query()
def spherical_density(spark, sf):
    """Points per area of the balls about each cell's points."""
    df = on_grid(walk(spark, sf))
    volumes = I.spherical_volume(df, G.grid_edges(spark, 10, 5))
    return rounded(I.density(A.counts(df, GRID.cells(spark)), volumes, least=1e-9), 6)


@query()
def potential_map(spark, sf):
    """Diffusivity and potential together on a grid of ten cells; tested by the slopes of the whole cost, which must vanish. The prior of D is in units
    of the table's own, large, diffusivities."""
    grid = Grid(0.0, 0.0, 100.0, 50.0, 5, 2)
    moves = T.to_translocations(steps(spark, sf)).withColumn("cell", grid.cell())
    cells = I.statistics(moves).where("k > 1").join(grid.cells(spark), "cell")
    return rounded(I.infer_dv(cells, G.grid_edges(spark, 5, 2), 1.0, 5e-10, tolerance=0.05), 2)


@query()
def smooth_forces(spark, sf):
    """Joint map of diffusivity and force under a smoothness prior; tested by the slope of the whole cost, which must vanish."""
    cells = I.statistics(_moves(spark, sf)).where("k > 1").join(GRID.cells(spark), "cell")
    return rounded(I.MODES["smooth.df"](cells, G.grid_edges(spark, 10, 5), 5e-10), 3)
