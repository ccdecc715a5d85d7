"""Queries on trajectories: steps, crops, splits, filters, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.functions.columns import in_box
from stepfield.operators import scaling
from stepfield.operators import trajectory as T
from stepfield.plans.common import MOVES, STEPS, WALK, W, r, rounded, steps, walk
from stepfield.plans.registry import query
from stepfield.sources import locations

BOX = ({"x": 50.0, "y": 10.0}, {"x": 400.0, "y": 80.0})
IN = "x BETWEEN 50 AND 400 AND y BETWEEN 10 AND 80"


@query(f"WITH {WALK}, {MOVES} SELECT n, row_id, {r('x')}, {r('y')}, {r('dx')}, {r('dy')}, {r('dt', digits=3)} FROM d")
def translocations(spark, sf):
    return rounded(T.to_translocations(walk(spark, sf)).select("n", "row_id", "x", "y", "dx", "dy", F.round("dt", 3).alias("dt")))


@query(f"WITH {WALK} SELECT n, row_id, {r('dx')}, {r('dy')} FROM (SELECT n, row_id, x - lag(x) OVER {W} AS dx, y - lag(y) OVER {W} AS dy FROM p) WHERE dx IS NOT NULL")
def displacements(spark, sf):
    return rounded(T.displacements(walk(spark, sf)))


@query(f"WITH {STEPS} SELECT n, {r('t')}, {r('x')}, {r('y')} FROM p WHERE n IN (SELECT n FROM p GROUP BY n HAVING count(*) > 1)")
def inverse_translocations(spark, sf):
    return rounded(T.to_trajectories(T.to_translocations(steps(spark, sf))).select("n", "t", "x", "y"), 6)


def _crop_sql(inside: str) -> str:
    return (
        f"WITH {STEPS}, a AS (SELECT *, {IN} AS i0 FROM p), b AS (SELECT *, {inside} AS i1, lead(x) OVER {W} - x AS dx, lead(y) OVER {W} - y AS dy FROM a), "
        f"s AS (SELECT *, sum(CASE WHEN i1 THEN 0 ELSE 1 END) OVER (PARTITION BY n ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS seg FROM b), "
        f"k AS (SELECT *, count(*) OVER (PARTITION BY n, seg) AS c FROM s WHERE i1) "
        f"SELECT n, row_id, CAST(seg AS BIGINT) AS seg, {r('dx')}, {r('dy')} FROM k WHERE c > 1"
    )


def _cropped(spark, sf, by=None):
    return rounded(T.crop(steps(spark, sf), *BOX, by=by).select("n", "row_id", "seg", "dx", "dy"))


@query(_crop_sql("i0"))
def crop_box(spark, sf):
    return _cropped(spark, sf)


@query(_crop_sql(f"i0 OR coalesce(lag(i0) OVER {W}, FALSE)"))
def crop_box_by_start(spark, sf):
    return _cropped(spark, sf, "start")


@query(_crop_sql(f"i0 OR coalesce(lead(i0) OVER {W}, FALSE)"))
def crop_box_by_stop(spark, sf):
    return _cropped(spark, sf, "stop")


@query(f"WITH {WALK} SELECT n, row_id, {r('x')}, {r('y')} FROM p WHERE {IN} AND t >= 1704500000 AND t <= 1705500000")
def roi_crop_with_time(spark, sf):
    return rounded(walk(spark, sf).where(in_box(*BOX) & F.col("t").between(1704500000, 1705500000)).select("n", "row_id", "x", "y"))




@query(
    f"WITH {WALK}, f AS (SELECT *, round_even(t / 86400e0, 0) - lag(round_even(t / 86400e0, 0)) OVER {W} > 1 AS g FROM p), "
    f"s AS (SELECT *, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS seg FROM f) "
    "SELECT CAST(dense_rank() OVER (ORDER BY n, seg) AS BIGINT) AS n, row_id FROM s"
)
def reindex_gaps(spark, sf):
    return T.reindex(walk(spark, sf), dt=86400.0).select("n", "row_id")


@query(
    f"WITH {WALK}, f AS (SELECT *, round_even(t / 86400e0, 0) - lag(round_even(t / 86400e0, 0)) OVER {W} > 1 AS g FROM p), "
    f"s AS (SELECT *, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS seg FROM f) "
    f"SELECT n, CAST(seg AS BIGINT) AS seg, count(*) AS k, {r('max(t) - min(t)', 'duration', 3)} FROM s GROUP BY n, seg"
)
def session_split(spark, sf):
    return rounded(T.split_at_gaps(walk(spark, sf), 86400.0).groupBy("n", "seg").agg(F.count("*").alias("k"), (F.max("t") - F.min("t")).alias("duration")), 3)


_STATIC = f"WITH {STEPS}, d AS (SELECT *, ((x - lag(x) OVER {W}) ** 2 + (y - lag(y) OVER {W}) ** 2) / 2 < 400 AS st FROM p), "


@query(_STATIC + "k AS (SELECT * FROM d WHERE NOT coalesce(st, FALSE)) SELECT n, row_id FROM (SELECT *, count(*) OVER (PARTITION BY n) AS c FROM k) WHERE c > 1")
def static_step_filter(spark, sf):
    return T.drop_static_steps(steps(spark, sf), 400.0).select("n", "row_id")


@query(_STATIC + "k AS (SELECT n FROM d GROUP BY n HAVING coalesce(avg(CASE WHEN st THEN 1e0 WHEN NOT st THEN 0e0 END), 0) < 0.18) SELECT n, row_id FROM d WHERE n IN (SELECT n FROM k)")
def static_trajectory_filter(spark, sf):
    return T.drop_static_trajectories(steps(spark, sf), 400.0, ratio=0.18).select("n", "row_id")


@query(f"WITH {WALK}, k AS (SELECT DISTINCT n FROM p QUALIFY row_number() OVER {W} = 1 AND x > 250) SELECT n, row_id, {r('x')} FROM p WHERE n IN (SELECT n FROM k)")
def full_trajectories_semi(spark, sf):
    df = walk(spark, sf)
    cropped = df.withColumn("k", F.row_number().over(T.along())).where("k = 1 and x > 250")
    return rounded(T.full_trajectories(cropped, df).select("n", "row_id", "x"))


@query(f"WITH {WALK}, k AS (SELECT * FROM p WHERE x > 300) SELECT n, row_id FROM k WHERE n IN (SELECT n FROM k GROUP BY n HAVING count(*) > 1)")
def singleton_anti(spark, sf):
    return T.drop_singletons(walk(spark, sf).where("x > 300")).select("n", "row_id")


@query(f"WITH {WALK} SELECT n, row_id, CAST(round_even((t - (SELECT min(t) FROM p)) / 3600e0, 0) AS BIGINT) AS frame FROM p")
def frame_index(spark, sf):
    return T.frames(walk(spark, sf), 3600.0).select("n", "row_id", "frame")


@query(
    f"WITH {WALK}, f AS (SELECT CAST(round_even((t - (SELECT min(t) FROM p)) / 3600e0, 0) AS BIGINT) AS frame FROM p) "
    "SELECT s.frame, count(f.frame) AS k FROM (SELECT unnest(range((SELECT min(frame) FROM f), (SELECT max(frame) FROM f) + 1)) AS frame) s LEFT JOIN f ON s.frame = f.frame GROUP BY s.frame"
)
def empty_frame_spine(spark, sf):
    return T.frame_counts(T.frames(walk(spark, sf), 3600.0))


@query(f"WITH {WALK}, d AS (SELECT x - lag(x) OVER {W} AS dx, y - lag(y) OVER {W} AS dy FROM p) SELECT count(*) AS steps, {r('avg(sqrt(dx * dx + dy * dy))', 'mean_step', 4)} FROM d WHERE dx IS NOT NULL")
def ref_distance(spark, sf):
    return rounded(T.mean_step(walk(spark, sf)), 4)


@query(
    f"WITH {WALK}, {MOVES} SELECT n, row_id, {r('dx')}, {r('dt', digits=3)} FROM d"
)
def negative_dt_repair(spark, sf):
    back = T.to_translocations(walk(spark, sf))
    turned = back.withColumns({c: F.when(F.col("row_id") % 2 == 0, -F.col(c)).otherwise(F.col(c)) for c in ("dx", "dy", "dt")})
    return rounded(T.repaired_steps(turned).select("n", "row_id", "dx", F.round("dt", 3).alias("dt")))


@query(f"WITH {WALK} SELECT s.n, s.row_id, f.source FROM (SELECT n, row_id, x, y, t FROM p) s LEFT JOIN (SELECT x, y, t, source FROM p) f ON s.x = f.x AND s.y = f.y AND s.t = f.t")
def join_by_values(spark, sf):
    df = walk(spark, sf)
    return T.join_by_values(df.select("n", "row_id", "x", "y", "t"), df.select("x", "y", "t", "source")).select("n", "row_id", "source")


@query(f"WITH {WALK} SELECT n, row_id FROM p WHERE n IN (SELECT n FROM p GROUP BY n HAVING count(DISTINCT x) > 60 AND max(sqrt(x * x + y * y)) < 495)")
def useful_walks(spark, sf):
    return T.useful(walk(spark, sf), 60, 495.0).select("n", "row_id")


@query(f"WITH {WALK} SELECT n, row_id, {r('(x - avg(x) OVER ()) / stddev_pop(x) OVER ()', 'x')}, {r('(y - avg(y) OVER ()) / stddev_pop(y) OVER ()', 'y')} FROM p")
def whiten(spark, sf):
    df = walk(spark, sf)
    return rounded(scaling.whiten(df, ["x", "y"]).scale_points(df).select("n", "row_id", "x", "y"))


@query(
    f"WITH {WALK}, s AS (SELECT avg(x) AS mx, avg(y) AS my, sqrt((avg(x * x) + avg(y * y)) / 2 - ((avg(x) + avg(y)) / 2) ** 2) AS f FROM p) "
    f"SELECT n, row_id, {r('(x - mx) / f', 'x')}, {r('(y - my) / f', 'y')} FROM p, s"
)
def whiten_euclidean(spark, sf):
    df = walk(spark, sf)
    return rounded(scaling.whiten(df, ["x", "y"], ["x", "y"]).scale_points(df).select("n", "row_id", "x", "y"))


@query(f"WITH {WALK}, s AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM p) SELECT n, row_id, {r('(x - ax) / (bx - ax)', 'x')}, {r('(y - ay) / (by_ - ay)', 'y')} FROM p, s")
def unitrange(spark, sf):
    df = walk(spark, sf)
    return rounded(scaling.unit_range(df, ["x", "y"]).scale_points(df).select("n", "row_id", "x", "y"))


@query(f"WITH {WALK} SELECT n, row_id, {r('x')}, {r('y')} FROM p")
def unscale_round_trip(spark, sf):
    df = walk(spark, sf)
    s = scaling.unit_range(df, ["x", "y"], ["x", "y"])
    return rounded(s.unscale_points(s.scale_points(df)).select("n", "row_id", "x", "y"))


@query(f"WITH {WALK}, q AS (SELECT quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b FROM p) SELECT n, row_id, {r('least(greatest(x, a), b)', 'x')} FROM p, q")
def clip_quantiles(spark, sf):
    return rounded(scaling.clip(walk(spark, sf), "x", 0.05, 0.95).select("n", "row_id", "x"))


@query(f"WITH {WALK} SELECT 'x' AS name, {r('min(x)', 'low')}, {r('max(x)', 'high')} FROM p UNION ALL SELECT 'y', round(min(y), 6) + 0e0, round(max(y), 6) + 0e0 FROM p")
def bounding_box(spark, sf):
    return rounded(locations.bounds(walk(spark, sf), ["x", "y"]))


@query(f"WITH {WALK} SELECT source, n, row_id, {r('x - min(x) OVER (PARTITION BY source)', 'x')}, {r('y - min(y) OVER (PARTITION BY source)', 'y')} FROM p")
def reset_origin_by_source(spark, sf):
    return rounded(locations.move_to_origin(walk(spark, sf), ["x", "y"], per_source=True).select("source", "n", "row_id", "x", "y"))


@query(f"WITH {WALK} SELECT n, row_id, {r('x - (SELECT min(x) FROM p)', 'x')} FROM p")
def reset_origin(spark, sf):
    return rounded(locations.move_to_origin(walk(spark, sf), ["x"]).select("n", "row_id", "x"))


@query(f"WITH {WALK} SELECT n, row_id, source FROM p WHERE source IN ('click', 'purchase')")
def split_by_source(spark, sf):
    return locations.by_source(walk(spark, sf), {"click", "purchase"}).select("n", "row_id", "source")


@query(f"WITH {WALK} SELECT n, count(*) AS k, {r('min(t)', 'start', 3)} FROM p GROUP BY n")
def trajectories_by_start(spark, sf):
    return rounded(T.ordered_by_start(walk(spark, sf)).groupBy("n").agg(F.count("*").alias("k"), F.first("start").alias("start")), 3)
