"""Queries on features of trajectories, and on regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.operators import features as X
from stepfield.operators import roi as R
from stepfield.plans.common import STEPS, WALK, W, r, rounded, rounded_distance, steps, walk
from stepfield.plans.registry import ORACLE, query

_LAGS = "(VALUES (1),(2),(3),(4),(5),(6),(8),(10)) l(lag)"
_RANKED = "q AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY t, row_id) AS i FROM p)"
_LAGGED = f"{_RANKED}, g AS (SELECT a.n, lag, b.x - a.x AS dx, b.y - a.y AS dy, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2 FROM q a, {_LAGS} JOIN q b ON b.n = a.n AND b.i = a.i + lag)"
_STEP = f"s AS (SELECT *, sqrt(dx * dx + dy * dy) AS step FROM (SELECT *, x - lag(x) OVER {W} AS dx, y - lag(y) OVER {W} AS dy FROM p))"


def _skew(v: str) -> str:
    return f"(avg({v} ** 3) - 3 * avg({v}) * avg({v} ** 2) + 2 * avg({v}) ** 3) / nullif(var_pop({v}), 0) ** 1.5"


@query(f"WITH {STEPS}, {_STEP} SELECT n, {r('avg(step)', 'step_mean', 4)}, {r('var_pop(step)', 'step_var', 2)}, {r(_skew('step'), 'step_skewness', 4)}, {r('kurtosis_pop(step)', 'step_kurtosis', 4)}, {r('min(step)', 'step_min', 4)}, {r('max(step)', 'step_max', 4)} FROM s WHERE step IS NOT NULL GROUP BY n")
def step_length_stats(spark, sf):
    return rounded(X.step_moments(steps(spark, sf)).withColumn("step_var", F.round("step_var", 2)), 4)


@query(f"WITH {STEPS}, {_LAGGED} SELECT n, lag, count(*) AS k, {r('avg(d2)', 'msd', 2)} FROM g GROUP BY n, lag")
def msd_by_lag(spark, sf):
    return rounded(X.msd(steps(spark, sf)), 2)


@query(
    f"WITH {STEPS}, {_LAGGED}, m AS (SELECT n, log10(lag) AS u, log10(avg(d2)) AS v FROM g GROUP BY n, lag) "
    f"SELECT n, {r('regr_slope(v, u)', 'msd_alpha')}, {r('corr(u, v)', 'msd_rval')}, {r('10 ** regr_intercept(v, u) / 4', 'msd_diffusion', 3)} FROM m GROUP BY n"
)
def msd_fit(spark, sf):
    return rounded(X.msd_fit(steps(spark, sf)).withColumn("msd_diffusion", F.round("msd_diffusion", 3)))


@query(f"WITH {STEPS}, v AS (SELECT n, (x - first(x) OVER {W}) / nullif(t - first(t) OVER {W}, 0) AS vx, (y - first(y) OVER {W}) / nullif(t - first(t) OVER {W}, 0) AS vy FROM p) SELECT n, {r('sqrt(avg(vx) ** 2 + avg(vy) ** 2)', 'drift_norm', 4)} FROM v GROUP BY n")
def drift_norm(spark, sf):
    return rounded(X.drift(steps(spark, sf)), 4)


@query(f"WITH {STEPS}, {_LAGGED}, h AS (SELECT n, lag, sqrt(d2) AS d FROM g) SELECT n, lag, {r('avg(d)', 'd_mean', 3)}, {r('var_pop(d)', 'd_var', 2)}, {r(_skew('d'), 'd_skewness', 4)}, {r('kurtosis_pop(d)', 'd_kurtosis', 4)} FROM h GROUP BY n, lag")
def displacement_moments_by_lag(spark, sf):
    return rounded(X.displacement_pdf(steps(spark, sf)).withColumns({"d_mean": F.round("d_mean", 3), "d_var": F.round("d_var", 2)}), 4)


_GYR = (
    "c AS (SELECT n, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM p GROUP BY n), "
    "k AS (SELECT n, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS l1, greatest((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 0) AS l2 FROM c) "
)


@query(f"WITH {WALK}, {_GYR} SELECT n, {r('l1', digits=3)}, {r('l2', digits=3)}, {r('-ln(1 - (l1 - l2) ** 2 / (2 * (l1 + l2) ** 2))', 'asymmetry')}, {r('(l1 - l2) ** 2 / (l1 + l2) ** 2', 'asphericity')} FROM k")
def gyration_shape(spark, sf):
    return rounded(X.gyration(walk(spark, sf)).withColumns({"l1": F.round("l1", 3), "l2": F.round("l2", 3)}))


@query(
    f"WITH {STEPS}, {_STEP}, e AS (SELECT n, arg_min(x, t) AS x0, arg_min(y, t) AS y0, arg_max(x, t) AS x1, arg_max(y, t) AS y1, sum(step * step) AS q, sum(step) AS w FROM s GROUP BY n) "
    f"SELECT n, {r('((x1 - x0) ** 2 + (y1 - y0) ** 2) / q', 'efficiency')}, {r('sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / w', 'straightness')} FROM e"
)
def efficiency_straightness(spark, sf):
    return rounded(X.efficiency(steps(spark, sf)))


@query(f"WITH {WALK}, c AS (SELECT n, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS a FROM p GROUP BY n), h AS (SELECT n, x * cos(a) + y * sin(a) AS v FROM p JOIN c USING (n)) SELECT n, {r('kurtosis_pop(v) + 3', 'axis_kurtosis', 4)} FROM h GROUP BY n")
def axis_kurtosis(spark, sf):
    return rounded(X.axis_kurtosis(walk(spark, sf)), 4)


_ANGLE = f"{_STEP}, b AS (SELECT *, lead(dx) OVER {W} AS ex, lead(dy) OVER {W} AS ey FROM s), z AS (SELECT n, row_id, t, acos(greatest(least((dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey)), 1), -1)) AS angle FROM b WHERE sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey) > 0)"


@query(f"WITH {STEPS}, {_ANGLE} SELECT n, row_id, {r('angle')} FROM z")
def turning_angles(spark, sf):
    return rounded(X.angles(steps(spark, sf)).select("n", "row_id", "angle"))


def _autocorrelation(source: str, column: str, lags: tuple[int, ...], prefix: str, digits: int) -> str:
    products = ", ".join(f"d * lead(d, {k}) OVER {W} AS p{k}" for k in lags)
    out = ", ".join(r(f"avg(p{k}) / any_value(v)", f"{prefix}_ac{k}") for k in lags)
    return f"h AS (SELECT n, row_id, t, {column} - avg({column}) OVER (PARTITION BY n) AS d, var_pop({column}) OVER (PARTITION BY n) AS v FROM {source}), j AS (SELECT *, {products} FROM h) SELECT n, {r('any_value(v)', f'{prefix}_var', digits)}, {out} FROM j GROUP BY n"


@query(f"WITH {STEPS}, {_ANGLE}, " + _autocorrelation("z", "angle", (1, 2), "angle", 6))
def angle_features(spark, sf):
    return rounded(X.angle_features(steps(spark, sf)))


@query(f"WITH {STEPS}, {_STEP}, " + _autocorrelation("(SELECT * FROM s WHERE step IS NOT NULL)", "step", (1, 2, 3), "step", 2))
def step_autocorr(spark, sf):
    return rounded(X.step_autocorrelation(steps(spark, sf)).withColumn("step_var", F.round("step_var", 2)))


@query(f"WITH {STEPS}, {_LAGGED} SELECT n, lag, {r('avg(d2 * d2) / avg(d2) ** 2 - 1', 'gaussianity')} FROM g GROUP BY n, lag")
def gaussianity(spark, sf):
    return rounded(X.gaussianity(steps(spark, sf)))


@query(
    f"WITH {STEPS}, {_LAGGED}, h AS (SELECT n, lag, avg(d2 * d2) / avg(d2) ** 2 - 1 AS v FROM g GROUP BY n, lag), j AS (SELECT *, (v - lag(v) OVER (PARTITION BY n ORDER BY lag)) / (lag - lag(lag) OVER (PARTITION BY n ORDER BY lag)) AS s FROM h) "
    f"SELECT n, {r('avg(v)', 'gaussianity_mean')}, {r('avg(s)', 'gaussianity_slope')} FROM j GROUP BY n"
)
def gaussianity_features(spark, sf):
    return rounded(X.gaussianity_features(steps(spark, sf)))


@query(f"WITH {STEPS}, {_LAGGED} SELECT n, {r('avg(cos(dx)) ** 2 + avg(sin(dx)) ** 2', 'ergodicity_x')}, {r('avg(cos(dy)) ** 2 + avg(sin(dy)) ** 2', 'ergodicity_y')} FROM g WHERE lag = 1 GROUP BY n")
def ergodicity(spark, sf):
    return rounded(X.ergodicity(steps(spark, sf)))


@query(f"WITH {STEPS}, {_STEP} SELECT n, row_id, {r(f'avg(step) OVER (PARTITION BY n ORDER BY t, row_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)', 'step_mean', 4)} FROM s")
def sliding_features(spark, sf):
    return rounded(X.sliding(steps(spark, sf), 6).select("n", "row_id", "step_mean"), 4)


@query(
    f"WITH {STEPS}, a AS (SELECT n, min(t) AS a, max(t) AS b FROM p GROUP BY n HAVING max(t) > min(t)), g AS (SELECT n, i, a + i * (b - a) / 20 AS u FROM a, range(21) r(i)), "
    f"s AS (SELECT *, lead(t) OVER {W} AS t1, lead(x) OVER {W} AS x1, lead(y) OVER {W} AS y1 FROM p), "
    f"k AS (SELECT g.n, CAST(g.i AS INT) AS i, u, s.*  EXCLUDE (n) FROM g JOIN s ON s.n = g.n AND u >= s.t - 1e-9 AND u <= s.t1 + 1e-9 QUALIFY row_number() OVER (PARTITION BY g.n, g.i ORDER BY s.t DESC) = 1) "
    f"SELECT n, i, {r('u', 't', 4)}, {r('x + (u - t) / (t1 - t) * (x1 - x)', 'x', 4)}, {r('y + (u - t) / (t1 - t) * (y1 - y)', 'y', 4)} FROM k"
)
def resample_20(spark, sf):
    return rounded(X.resampled(steps(spark, sf), 21), 4)


@query(f"WITH {WALK} SELECT n, count(*) AS size, {r('min(t)', 't_min', 3)}, {r('max(t)', 't_max', 3)}, {r('(max(t) - min(t)) / (count(*) - 1)', 'dt', 3)}, FALSE AS is_dt_constant FROM p GROUP BY n HAVING count(*) > 2")
def trajectory_spans(spark, sf):
    return rounded(X.spans(walk(spark, sf)).where("size > 2"), 3)


@query(
    f"WITH {WALK}, {_RANKED}, m AS (SELECT a.n, a.i, coalesce(max(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))), 0) AS m FROM q a LEFT JOIN q b ON b.n = a.n AND b.i > a.i GROUP BY a.n, a.i) "
    f"SELECT n, {r('quantile_cont(m, 0.75)', 'escape_q1', 4)}, {r('quantile_cont(m, 0.5)', 'escape_median', 4)}, {r('quantile_cont(m, 0.25)', 'escape_q3', 4)} FROM m GROUP BY n"
)
def escape_distances(spark, sf):
    return rounded(X.escape_distances(walk(spark, sf)), 4)


#: A pair of corners is an edge of the hull if no position lies right of it, or on its line beyond either end.
_HULL = (
    "u AS (SELECT DISTINCT n, x, y FROM p), e AS (SELECT a.n, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM u a JOIN u b ON a.n = b.n AND (a.x <> b.x OR a.y <> b.y)), "
    "s AS (SELECT e.*, (qx - px) * (c.y - py) - (qy - py) * (c.x - px) AS side, (c.x - px) * (qx - px) + (c.y - py) * (qy - py) AS along, (qx - px) ** 2 + (qy - py) ** 2 AS d2 FROM e JOIN u c ON c.n = e.n), "
    "h AS (SELECT n, px, py, qx, qy FROM s GROUP BY ALL HAVING min(side) >= -1e-9 AND count(*) FILTER (abs(side) <= 1e-9 AND (along < -1e-9 OR along > d2 + 1e-9)) = 0) "
)


@query(f"WITH {WALK}, {_HULL}, m AS (SELECT n, abs(sum(px * qy - qx * py)) / 2 AS area, sum(sqrt((qx - px) ** 2 + (qy - py) ** 2)) AS perimeter FROM h GROUP BY n), w AS (SELECT n, max(sqrt((qx - px) ** 2 + (qy - py) ** 2)) AS wide FROM e GROUP BY n) SELECT n, {r('coalesce(area, 0)', 'hull_area', 4)}, {r('coalesce(perimeter, 0)', 'hull_perimeter', 4)}, {r('coalesce(wide, 0)', 'hull_diameter', 4)} FROM (SELECT DISTINCT n FROM u) LEFT JOIN m USING (n) LEFT JOIN w USING (n)")
def convex_hull(spark, sf):
    return rounded(X.convex_hull(walk(spark, sf)), 4)


_PDF = (
    f"WITH {STEPS}, {_LAGGED}, h AS (SELECT n, lag, sqrt(d2) AS d FROM g), m AS (SELECT n, log10(lag) AS u, log10(nullif(avg(d), 0)) AS a, log10(nullif(var_pop(d), 0)) AS b, {_skew('d')} AS s, kurtosis_pop(d) AS k FROM h GROUP BY n, lag) "
    f"SELECT n, {r('regr_slope(a, u)', 'pdf_mean_alpha')}, {r('regr_slope(b, u)', 'pdf_var_alpha')}, {r('avg(s)', 'pdf_skewness_mean')}, {r('var_pop(s)', 'pdf_skewness_var')}, {r('avg(k)', 'pdf_kurtosis_mean')}, {r('var_pop(k)', 'pdf_kurtosis_var')} FROM m GROUP BY n"
)


@query(_PDF)
def displacement_fit(spark, sf):
    """Power laws of the mean distance and of its variance over lags; mean and variance of skewness and kurtosis."""
    return rounded(X.displacement_pdf_fit(steps(spark, sf)))


_ROI = "b AS (SELECT i AS idx, (i % 6) * 70e0 AS x_min, (i % 6) * 70e0 + 80e0 AS x_max, (i // 6) * 30e0 AS y_min, (i // 6) * 30e0 + 25e0 AS y_max FROM range(18) r(i))"


def _boxes(spark):
    i = F.col("id")
    return spark.range(18).select(i.alias("idx"), ((i % 6) * 70.0).alias("x_min"), ((i % 6) * 70.0 + 80.0).alias("x_max"), (F.floor(i / 6) * 30.0).alias("y_min"), (F.floor(i / 6) * 30.0 + 25.0).alias("y_max"))


@query(f"WITH {WALK}, {_ROI} SELECT idx, row_id FROM p JOIN b ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max")
def roi_range_join(spark, sf):
    return R.crop_each(walk(spark, sf), _boxes(spark)).select("idx", "row_id")


@query(f"WITH {WALK}, {_ROI} SELECT DISTINCT row_id FROM p JOIN b ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max")
def roi_union_crop(spark, sf):
    return R.crop_union(walk(spark, sf), _boxes(spark)).select("row_id")


@query(f"WITH {WALK} SELECT row_id, count(*) OVER (PARTITION BY source ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS recent FROM p")
def trailing_range_count(spark, sf):
    return R.trailing_counts(walk(spark, sf), 21600.0).select("row_id", "recent")


@query(
    f"WITH {WALK}, c AS (SELECT *, count(*) OVER (PARTITION BY source ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS recent FROM p), "
    "b AS (SELECT *, t - lag(t) OVER (PARTITION BY source ORDER BY t, row_id) > 7200 AS cut FROM c WHERE recent >= 12), "
    "g AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS period FROM b) "
    f"SELECT source, period, {r('min(t)', 'start', 3)}, {r('max(t)', 'stop', 3)}, count(*) AS k FROM g GROUP BY source, period"
)
def busy_periods(spark, sf):
    return rounded(R.busy_periods(walk(spark, sf), 21600.0, 12, 7200.0), 3)


@query(f"WITH {WALK} SELECT row_id, {r('sqrt((x - 250) ** 2 + (y - 50) ** 2)', 'distance')} FROM p")
def distance_to_centre(spark, sf):
    return rounded(R.distance_to_centre(walk(spark, sf), 250.0, 50.0).select("row_id", "distance"))


@query(
    f"WITH {WALK}, f AS (SELECT *, CAST(floor(t / 86400e0) AS BIGINT) AS frame FROM p) SELECT a.row_id AS a, b.row_id AS b, {r('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', 'distance')} FROM f a JOIN f b ON b.frame = a.frame + 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100"
)
def next_frame_candidates(spark, sf):
    return rounded_distance(_candidates(spark, sf))


@query(
    f"WITH {WALK}, f AS (SELECT *, CAST(floor(t / 86400e0) AS BIGINT) AS frame FROM p), c AS (SELECT a.row_id AS a, b.row_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM f a JOIN f b ON b.frame = a.frame + 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100), "
    "u AS (SELECT a, b FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1), v AS (SELECT a, b FROM c QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, a) = 1) SELECT u.a, u.b FROM u JOIN v ON u.a = v.a AND u.b = v.b"
)
def mutual_links(spark, sf):
    return R.mutual_next_frame_links(_framed(spark, sf), 10.0).select("a", "b")


def _framed(spark, sf):
    return walk(spark, sf).withColumn("frame", F.floor(F.col("t") / 86400.0))


def _candidates(spark, sf):
    return R.next_frame_candidates(_framed(spark, sf), 10.0)


_PEAKS = (
    "o AS (SELECT CAST(i AS INT) AS o FROM range(-4, 5) r(i)), w AS (SELECT CAST(round_even(x / 10e0, 0) + a.o AS BIGINT) AS gx, CAST(round_even(y / 10e0, 0) + b.o AS BIGINT) AS gy, x, y FROM p, o a, o b), "
    "k AS (SELECT gx, gy, sum(1 - ((gx * 10e0 - x) ** 2 + (gy * 10e0 - y) ** 2) / 625e0) AS density FROM w WHERE (gx * 10e0 - x) ** 2 + (gy * 10e0 - y) ** 2 < 625 GROUP BY gx, gy HAVING density >= 5) "
)


@query(f"WITH {WALK}, {_PEAKS} SELECT gx, gy, {r('density')} FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE abs(b.gx - a.gx) <= 2 AND abs(b.gy - a.gy) <= 2 AND (b.density > a.density + 1e-9 OR (b.density >= a.density - 1e-9 AND (b.gx < a.gx OR (b.gx = a.gx AND b.gy < a.gy)))))")
def density_peaks(spark, sf):
    return rounded(R.density_peaks(walk(spark, sf), 10.0, 25.0, 5.0))
