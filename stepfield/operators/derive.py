"""Derivatives of maps (cell, c_x, c_y, value) over cell graphs, and along segments of time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _near(maps: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    a = maps.select(F.col("cell").alias("i"), F.col("c_x").alias("ix"), F.col("c_y").alias("iy"), F.col(value).alias("iv"))
    b = maps.select(F.col("cell").alias("j"), F.col("c_x").alias("jx"), F.col("c_y").alias("jy"), F.col(value).alias("jv"))
    return edges.select("i", "j").join(a, "i").join(b, "j").where("iv is not null and jv is not null")


def gradient_options(eps: float | None = None, angle: float | None = None) -> dict[str, float]:
    """How neighbours are chosen: by a margin, or else by the opening of a cone about each axis, in units of pi (0.9 if neither is given)."""
    return {"eps": eps} if eps is not None else {"angle": angle or 0.9}


def _sides(axis: str, eps: float, angle: float | None = None) -> dict[str, Column]:
    d = F.col(f"j{axis}") - F.col(f"i{axis}")
    if angle is not None:
        d = 1 - F.acos(d / F.hypot(F.col("jx") - F.col("ix"), F.col("jy") - F.col("iy"))) * (2 / math.pi)
        eps = 1 - angle
    below, above = d < -eps, d > eps
    return {
        f"{axis}u": F.avg(F.when(below, F.col(f"j{axis}"))), f"{axis}v": F.avg(F.when(above, F.col(f"j{axis}"))),
        f"{axis}yu": F.avg(F.when(below, F.col("jv"))), f"{axis}yv": F.avg(F.when(above, F.col("jv"))),
    }


def _parabola(x0: Column, y0: Column, xu: Column, yu: Column, xv: Column, yv: Column) -> Column:
    """Derivative at x0 of the parabola through three points; of the line, if one side is missing; else null."""
    su, sv = (y0 - yu) / (x0 - xu), (yv - y0) / (xv - x0)
    both = (su * (xv - x0) + sv * (x0 - xu)) / (xv - xu)
    return F.when(xu.isNotNull() & xv.isNotNull(), both).when(xu.isNotNull(), su).when(xv.isNotNull(), sv)


def gradient(maps: DataFrame, edges: DataFrame, value: str, eps: float = 1e-9, angle: float | None = None) -> DataFrame:
    """(cell, grad_x, grad_y): along each axis the neighbours below and above are averaged, and a parabola laid through. Neighbours count that lie
    beyond a margin eps, or, given an angle, within cones of angle * pi about the axis."""
    near = _near(maps, edges, value).groupBy("i", "ix", "iy", "iv").agg(*(v.alias(k) for a in ("x", "y") for k, v in _sides(a, eps, angle).items()))
    c = F.col
    return near.select(c("i").alias("cell"), *(_parabola(c(f"i{a}"), c("iv"), c(f"{a}u"), c(f"{a}yu"), c(f"{a}v"), c(f"{a}yv")).alias(f"grad_{a}") for a in ("x", "y")))


def gradients(maps: DataFrame, edges: DataFrame, values: list[str]) -> DataFrame:
    """Gradients of several features, named grad_x_<feature>."""
    out = None
    for v in values:
        g = gradient(maps, edges, v).select("cell", *(F.col(f"grad_{a}").alias(f"grad_{a}_{v}") for a in ("x", "y")))
        out = g if out is None else out.join(g, "cell", "full")
    return out


def one_sided(maps: DataFrame, edges: DataFrame, value: str, eps: float = 1e-9) -> DataFrame:
    """(cell, below_x, above_x, below_y, above_y): slopes to the mean neighbour on each side, 0 where there is none."""
    near = _near(maps, edges, value).groupBy("i", "ix", "iy", "iv").agg(*(v.alias(k) for a in ("x", "y") for k, v in _sides(a, eps).items()))
    c = F.col
    out = []
    for a in ("x", "y"):
        out += [F.coalesce((c("iv") - c(f"{a}yu")) / (c(f"i{a}") - c(f"{a}u")), F.lit(0.0)).alias(f"below_{a}"), F.coalesce((c(f"{a}yv") - c("iv")) / (c(f"{a}v") - c(f"i{a}")), F.lit(0.0)).alias(f"above_{a}")]
    return near.select(c("i").alias("cell"), *out)


def variations(maps: DataFrame, edges: DataFrame, value: str, scaled: bool = True) -> DataFrame:
    """(i, j, delta): slopes to each neighbour, divided by the root of their number if scaled."""
    near = _near(maps, edges, value).withColumn("delta", (F.col("jv") - F.col("iv")) / F.hypot(F.col("jx") - F.col("ix"), F.col("jy") - F.col("iy")))
    if scaled:
        near = near.withColumn("delta", F.col("delta") / F.sqrt(F.count("*").over(Window.partitionBy("i"))))
    return near.select("i", "j", "delta")


def gradient_sum(grads: DataFrame, cells: DataFrame) -> DataFrame:
    """volume * (squared gradient), the penalty of a smooth map; null parts count 0, a volume that is null or 0 counts 1."""
    total = sum((F.coalesce(F.col(f"grad_{a}") * F.col(f"grad_{a}"), F.lit(0.0)) for a in ("x", "y")), F.lit(0.0))
    v = F.when(F.coalesce("volume", F.lit(0.0)) > 0, F.col("volume")).otherwise(1.0)
    return grads.join(cells.select("cell", "volume"), "cell").select("cell", (v * total).alias("penalty"))


def time_derivative(maps: DataFrame, value: str) -> DataFrame:
    """maps (cell, seg, mid, value): derivative in time of the parabola through the segments before and after."""
    w = Window.partitionBy("cell").orderBy("seg")
    c = F.col
    prior, later = (lambda k: F.when(F.lag("seg").over(w) == c("seg") - 1, F.lag(k).over(w))), (lambda k: F.when(F.lead("seg").over(w) == c("seg") + 1, F.lead(k).over(w)))
    out = maps.withColumns({"_xu": prior("mid"), "_yu": prior(value), "_xv": later("mid"), "_yv": later(value)})
    return out.withColumn("dv_dt", _parabola(c("mid"), c(value), c("_xu"), c("_yu"), c("_xv"), c("_yv"))).drop("_xu", "_yu", "_xv", "_yv")


def time_variation(maps: DataFrame, value: str) -> DataFrame:
    """Slopes to the segment before and after, 0 where there is none."""
    w = Window.partitionBy("cell").orderBy("seg")
    c = F.col
    before = F.when(F.lag("seg").over(w) == c("seg") - 1, (c(value) - F.lag(value).over(w)) / (c("mid") - F.lag("mid").over(w)))
    after = F.when(F.lead("seg").over(w) == c("seg") + 1, (F.lead(value).over(w) - c(value)) / (F.lead("mid").over(w) - c("mid")))
    return maps.withColumns({"slope_before": F.coalesce(before, F.lit(0.0)), "slope_after": F.coalesce(after, F.lit(0.0))})


def grid_curl(maps: DataFrame, nx: int, ny: int, fx: str, fy: str, width: float, height: float) -> DataFrame:
    """Curl of a field on a grid numbered row by row: the circulation round the 8 cells about a cell over the area of the ring's inside,
    for cells whose ring is whole. The ring is one array, walked in order; a tangent is half the chord from the cell before to the one after."""
    ring = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]
    rows = []
    for k, (a, b) in enumerate(ring):
        (pa_, pb), (na, nb) = ring[k - 1], ring[(k + 1) % 8]
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((na - pa_) * width / 2).alias("tx"), F.lit((nb - pb) * height / 2).alias("ty")))
    at = maps.select("cell", F.floor(F.col("cell") / ny).alias("gx"), (F.col("cell") % ny).alias("gy"), F.explode(F.array(*rows)).alias("o"))
    at = at.select("cell", (F.col("gx") + F.col("o.a")).alias("gx"), (F.col("gy") + F.col("o.b")).alias("gy"), "o.tx", "o.ty").where(F.col("gx").between(0, nx - 1) & F.col("gy").between(0, ny - 1))
    field = maps.select((F.floor(F.col("cell") / ny)).alias("gx"), (F.col("cell") % ny).alias("gy"), F.col(fx).alias("fx"), F.col(fy).alias("fy")).where("fx is not null and fy is not null")
    turn = at.join(field, ["gx", "gy"]).groupBy("cell").agg(F.count("*").alias("k"), F.sum(F.col("fx") * F.col("tx") + F.col("fy") * F.col("ty")).alias("c"))
    return turn.where("k = 8").select("cell", (F.col("c") / (4 * width * height)).alias("curl"))


def rings(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, j, tx, ty): the neighbours of a cell that close a ring about it, each with half the chord from the one before to the one after,
    counter-clockwise. Neighbours are ordered by direction; a ring is closed if each is a neighbour of the next, so cells at the border have
    none. A window holds one cell's neighbours."""
    e = edges.select("i", "j").distinct()
    at = lambda k: cells.select(F.col("cell").alias(k), F.col("c_x").alias(f"{k}x"), F.col("c_y").alias(f"{k}y"))
    near = e.join(at("i"), "i").join(at("j"), "j").withColumn("turn", F.atan2(F.col("jy") - F.col("iy"), F.col("jx") - F.col("ix")))
    w, whole = Window.partitionBy("i").orderBy("turn", "j"), Window.partitionBy("i").orderBy("turn", "j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = (lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))), (lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)))
    ring = near.select("i", "j", after("j").alias("next"), *(((after(f"j{a}") - before(f"j{a}")) / 2).alias(f"t{a}") for a in ("x", "y")))
    ring = ring.join(e.select(F.col("i").alias("j"), F.col("j").alias("next"), F.lit(1).alias("joined")), ["j", "next"], "left")
    own = Window.partitionBy("i")
    ring = ring.withColumns({"joints": F.count("joined").over(own), "size": F.count("*").over(own)})
    return ring.where("size > 2 and joints = size").select(F.col("i").alias("cell"), "j", "tx", "ty")


def ring_curl(maps: DataFrame, edges: DataFrame, fx: str, fy: str) -> DataFrame:
    """(cell, curl): circulation of a field along the ring of neighbours over the area inside it, which is the cell's own volume; for cells of any
    shape. Neighbours of null field add nothing; a volume of 0 gives 0."""
    field = maps.select(F.col("cell").alias("j"), F.col(fx).alias("fx"), F.col(fy).alias("fy"))
    turn = rings(maps, edges).join(field, "j").groupBy("cell").agg(F.sum(F.coalesce(F.col("fx") * F.col("tx") + F.col("fy") * F.col("ty"), F.lit(0.0))).alias("c"))
    return turn.join(maps.select("cell", "volume"), "cell").select("cell", F.when(F.abs("volume") > 1e-8, F.col("c") / F.col("volume")).otherwise(0.0).alias("curl"))


def quadratic_gradient(maps: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """(cell, grad_x, grad_y): least-squares quadratic surface through a cell and its neighbours, in coordinates about the cell, which must lie on
    it; with too few neighbours the surface of least norm. A group is one cell's neighbourhood."""

    def fit(table: pa.Table) -> pa.Table:
        dx, dy, dv = (table.column(a).to_numpy() - table.column(b).to_numpy() for a, b in (("jx", "ix"), ("jy", "iy"), ("jv", "iv")))
        a = np.stack([dx, dy, dx * dx, dx * dy, dy * dy], 1)
        g = np.linalg.lstsq(a, dv, rcond=None)[0]
        return pa.table({"cell": table.column("i").slice(0, 1).cast(pa.int32()), "grad_x": [float(g[0])], "grad_y": [float(g[1])]})

    near = _near(maps, edges, value).select(F.col("i").cast("int"), *(F.col(c).cast("double") for c in ("ix", "iy", "iv", "jx", "jy", "jv")))
    return near.groupBy("i").applyInArrow(fit, "cell int, grad_x double, grad_y double")


def inner_area(cells: DataFrame, edges: DataFrame, distance: int = 1) -> DataFrame:
    """(cell, area): the volumes of a cell and of all cells fewer than `distance` steps away, which a contour at that distance has inside."""
    near = edges.select("i", "j").distinct()
    inside = cells.select("cell", F.col("cell").alias("j"))
    for _ in range(distance - 1):
        inside = inside.unionByName(inside.withColumnRenamed("j", "i").join(near, "i").select("cell", "j")).distinct()
    return inside.join(cells.select(F.col("cell").alias("j"), "volume"), "j").groupBy("cell").agg(F.sum("volume").alias("area"))
