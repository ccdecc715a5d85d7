"""Per-cell inference of diffusivity, drift and force from translocations (cell, dx, dy, dt)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.operators.durations import infer_any_dt  # noqa: F401
from stepfield.operators.features import _hull, hull_corners
from stepfield.operators.potential import SIGMA2, SWEEPS, infer_dv
from stepfield.sources.storage import checkpointed


def statistics(steps: DataFrame, *by: str) -> DataFrame:
    """Sufficient statistics of a constant time step: k, s (sum of squares), m_x, m_y (sums), dt (mean), dt_max."""
    return steps.groupBy(*(by or ("cell",))).agg(
        F.count("*").alias("k"), F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("s"), F.sum("dx").alias("m_x"), F.sum("dy").alias("m_y"), F.avg("dt").alias("dt"), F.max("dt").alias("dt_max")
    )


def _bounded(d, sigma2: float):
    return F.greatest(d, (F.lit(1e-16) - sigma2) / F.col("dt_max"))


def infer_d(steps: DataFrame, sigma2: float = SIGMA2, jeffreys: bool = False, *by: str) -> DataFrame:
    """Maximum a posteriori diffusivity; the steps of a cell share one duration."""
    j = 2 if jeffreys else 0
    d = (F.col("s") / (4.0 * (F.col("k") + j)) - sigma2) / F.col("dt")
    return statistics(steps, *by).withColumn("diffusivity", _bounded(d, sigma2))


def _residual():
    return F.col("s") - (F.col("m_x") * F.col("m_x") + F.col("m_y") * F.col("m_y")) / F.col("k")


def infer_dd(steps: DataFrame, sigma2: float = SIGMA2, jeffreys: bool = False, *by: str) -> DataFrame:
    """Diffusivity and drift."""
    j = 2 if jeffreys else 0
    d = (_residual() / (4.0 * (F.col("k") + j)) - sigma2) / F.col("dt")
    return statistics(steps, *by).withColumns({"diffusivity": _bounded(d, sigma2), "drift_x": F.col("m_x") / (F.col("k") * F.col("dt")), "drift_y": F.col("m_y") / (F.col("k") * F.col("dt"))})


def infer_df(steps: DataFrame, sigma2: float = SIGMA2, jeffreys: bool = False, *by: str) -> DataFrame:
    """Diffusivity and force (drift over diffusivity). With Jeffreys' prior the larger root of n s^2 - ((n + 2) sigma2 + R / 4) s + R sigma2 / 4 = 0."""
    r, k = _residual(), F.col("k")
    if jeffreys:
        b = (k + 2) * sigma2 + r / 4
        s = (b + F.sqrt(F.greatest(b * b - k * r * sigma2, F.lit(0.0)))) / (2 * k)
    else:
        s = r / (4.0 * k)
    out = statistics(steps, *by).withColumn("diffusivity", _bounded((s - sigma2) / F.col("dt"), sigma2))
    return out.withColumns({f"force_{c}": F.col(f"m_{c}") / (k * F.col("dt") * F.col("diffusivity")) for c in ("x", "y")})


def smooth_joined(cells: DataFrame, edges: DataFrame, prior: float, mode: str = "d", sigma2: float = SIGMA2, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """Joint maps over cells (statistics() with volume): the per-cell posteriors and `prior` times volume times the squared differences of D between
    neighbours, in rounds of edge joins: (cell, diffusivity), with drift (mode dd) or force (df) as a_x, a_y. A cell's part
    of the cost, given its neighbours' last diffusivities, is settled by bisection in one expression; SWEEPS of them are written at a time.
    Ends when no diffusivity moves by more than `tolerance` of the mean one, and raises if `rounds` don't settle it: a prior that outweighs
    the steps takes many. Only that one number reaches the driver; cells without steps have no row."""
    own = cells.where("k > 0").withColumn("v", F.col("volume").cast("double") if "volume" in cells.columns else F.lit(1.0))
    own = checkpointed(own.select("cell", F.col("k").cast("double").alias("k"), "dt", "m_x", "m_y", (F.col("s") if mode == "d" else _residual()).cast("double").alias("r"), "v"))
    pairs = edges.select("i", "j").distinct()
    for c in ("i", "j"):
        pairs = pairs.join(own.select(F.col("cell").alias(c), F.col("v").alias(f"v_{c}")), c)
    pull = checkpointed(pairs.select("i", "j", (prior * (F.col("v_i") + F.col("v_j"))).alias("w")))
    # With scale = d dt + sigma2, the slope of k log(scale) + r / (4 scale) + w (d - near)^2 has the sign of this cubic in scale.
    mid, s2 = "((b.low + b.high) / 2)", f"{sigma2!r}D"
    cubic = f"2 * w / (dt * dt) * ({mid} - {s2} - near * dt) * {mid} * {mid} + k * {mid} - r / 4"
    start = f"named_struct('low', 0D, 'high', greatest({s2} + near * dt, r / (4 * k)))"
    step = f"(b, n) -> if({cubic} > 0, named_struct('low', b.low, 'high', {mid}), named_struct('low', {mid}, 'high', b.high))"
    settled = F.expr(f"(aggregate(sequence(1, 60), {start}, {step}, b -> {mid}) - {s2}) / dt")

    def sweep(now):
        near = pull.join(now.select(F.col("cell").alias("j"), F.col("d").alias("d_j")), "j").groupBy(F.col("i").alias("cell")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("d_j")).alias("wd"))
        joined = own.select("cell", "k", "dt", "r").join(near, "cell", "left").join(now.select("cell", "d"), "cell").fillna(0.0, ["w"])
        return joined.withColumn("near", F.coalesce(F.try_divide("wd", "w"), "d")).select("cell", F.col("d").alias("before"), settled.alias("d"))

    now = checkpointed(own.select("cell", ((F.col("r") / (4 * F.col("k")) - sigma2) / F.col("dt")).alias("d")))
    for _ in range(-(-rounds // SWEEPS)):
        for _ in range(SWEEPS):
            now = sweep(now)
        now = checkpointed(now)
        moved, mean = now.agg(F.max(F.abs(F.col("d") - F.col("before"))), F.avg(F.abs("d"))).first()
        if moved is None or moved <= tolerance * mean:
            break
    else:
        raise RuntimeError(f"diffusivities not settled after {rounds} rounds")
    out = own.join(now.select("cell", F.col("d").alias("diffusivity")), "cell")
    if mode == "d":
        return out.select("cell", "diffusivity")
    per = F.col("k") * F.col("dt") * (F.col("diffusivity") if mode == "df" else F.lit(1.0))
    return out.select("cell", "diffusivity", (F.col("m_x") / per).alias("a_x"), (F.col("m_y") / per).alias("a_y"))


def snr(steps: DataFrame) -> DataFrame:
    """Per cell: k, mean step, biased variance, that of all other cells, and zeta_total = mean / sqrt(variance), for cells of more than one step. One shuffle
    to per-cell sums; the totals are one row."""
    per = steps.groupBy("cell").agg(F.count("*").alias("k"), F.sum("dx").alias("m_x"), F.sum("dy").alias("m_y"), F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("s"))
    t = per.agg(F.sum("k"), F.sum("m_x"), F.sum("m_y"), F.sum("s")).first()
    k, mx, my, s = (F.lit(x) for x in t)
    per = per.withColumn("variance", (F.col("s") - (F.col("m_x") * F.col("m_x") + F.col("m_y") * F.col("m_y")) / F.col("k")) / F.col("k"))
    ok, ox, oy, os = k - F.col("k"), mx - F.col("m_x"), my - F.col("m_y"), s - F.col("s")
    per = per.withColumn("prior_variance", (os - (ox * ox + oy * oy) / F.nullif(ok, F.lit(0))) / F.nullif(ok, F.lit(0)))
    zeta = {f"zeta_{c}": F.when((F.col("k") > 1) & (F.col("variance") > 0), F.col(f"m_{c}") / F.col("k") / F.sqrt("variance")) for c in ("x", "y")}
    return per.withColumns(zeta)


def spurious_zeta(maps: DataFrame, dt: float) -> DataFrame:
    """maps with grad_x, grad_y of the diffusivity and variance: zeta_spurious = grad D dt / sqrt(V); null where no step varies."""
    return maps.withColumns({f"spurious_{c}": F.col(f"grad_{c}") * dt / F.sqrt(F.when(F.col("variance") > 0, F.col("variance"))) for c in ("x", "y")})


def conjugate_map(maps: DataFrame, dt: float, prior_weight: int = 3, dim: int = 2) -> DataFrame:
    """snr() maps: the conjugate prior's mode of the diffusivity, with `prior_weight` pseudo-steps of the other cells' variance; null where no step varies."""
    eta2 = prior_weight / (F.col("k") + prior_weight)
    v = 1 + prior_weight / F.col("k") * F.col("prior_variance") / F.nullif("variance", F.lit(0.0))
    g3 = v + eta2 * (F.col("zeta_x") * F.col("zeta_x") + F.col("zeta_y") * F.col("zeta_y"))
    p = dim * (F.col("k") + prior_weight - 1) / 2 - 1
    return maps.withColumn("map_diffusivity", F.col("k") * F.col("variance") * g3 / (4 * dt * (p + 1)))


def border_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Per cell whether no neighbour lies beyond it on an axis: low_x, high_x, low_y, high_y."""
    c = cells.select("cell", "c_x", "c_y")
    near = edges.join(c.select(F.col("cell").alias("i"), F.col("c_x").alias("ix"), F.col("c_y").alias("iy")), "i").join(c.select(F.col("cell").alias("j"), "c_x", "c_y"), "j")
    side = near.groupBy(F.col("i").alias("cell")).agg(F.min(F.col("c_x") - F.col("ix")).alias("a"), F.max(F.col("c_x") - F.col("ix")).alias("b"), F.min(F.col("c_y") - F.col("iy")).alias("d"), F.max(F.col("c_y") - F.col("iy")).alias("e"))
    return side.select("cell", (F.col("a") >= 0).alias("low_x"), (F.col("b") <= 0).alias("high_x"), (F.col("d") >= 0).alias("low_y"), (F.col("e") <= 0).alias("high_y"))


def merge_small(counts: DataFrame, cells: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(cell, target): cells of fewer points than `least` go to the nearest neighbour that has as many; others, and those without one, stay."""
    c = cells.select("cell", "c_x", "c_y").join(counts, "cell")
    near = edges.join(c.select(F.col("cell").alias("i"), F.col("c_x").alias("ix"), F.col("c_y").alias("iy"), F.col("k").alias("ki")), "i").join(c.select(F.col("cell").alias("j"), "c_x", "c_y", F.col("k").alias("kj")), "j")
    best = near.where((F.col("ki") < least) & (F.col("kj") >= least)).groupBy(F.col("i").alias("cell")).agg(F.min(F.struct(F.hypot(F.col("c_x") - F.col("ix"), F.col("c_y") - F.col("iy")).alias("d"), F.col("j"))).alias("b"))
    return counts.select("cell").join(best, "cell", "left").select("cell", F.coalesce("b.j", "cell").alias("target"))


#: Modes by name, as plug-ins are looked up.
MODES = {"d": infer_d, "dd": infer_dd, "ddrift": infer_dd, "df": infer_df, "unsmooth.d": infer_d, "unsmooth.dd": infer_dd, "unsmooth.df": infer_df, "snr": snr, "d.conj_prior": conjugate_map, "smooth.d": smooth_joined, "smooth.dd": partial(smooth_joined, mode="dd"), "smooth.df": partial(smooth_joined, mode="df"), "dv": infer_dv}


def group_sum(maps: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """Sum of a column over each group of cells."""
    return maps.join(groups, "cell").withColumn(f"group_{column}", F.sum(column).over(Window.partitionBy("group")))


def _ball(p: np.ndarray) -> tuple[np.ndarray, float]:
    """A ball that holds all points: through two far ones, then grown to each point outside."""
    a = p[((p - p[0]) ** 2).sum(1).argmax()]
    b = p[((p - a) ** 2).sum(1).argmax()]
    centre, radius = (a + b) / 2, float(np.hypot(*(a - b))) / 2
    for q in p:
        d = float(np.hypot(*(q - centre)))
        if d > radius:
            radius, centre = (radius + d) / 2, centre + (q - centre) * (d - radius) / (2 * d)
    return centre, radius


def spherical_volume(points: DataFrame, edges: DataFrame, dim: int = 2) -> DataFrame:
    """(cell, radius, volume): a ball about each cell's points, enlarged to the nearest point of a neighbouring cell; its area (dim 2) or volume (dim 3).
    Balls hang on the corners of the cells' hulls alone, taken in order, so they don't depend on the order of rows, and a cell's points don't meet in one task; the
    nearest foreign point comes from a join of neighbours on the cell, reduced to a minimum."""

    def run(table: pa.Table) -> pa.Table:
        centre, radius = _ball(_hull(np.stack([table.column("x").to_numpy(), table.column("y").to_numpy()], 1)))
        return pa.table({"cell": table.column("cell").slice(0, 1), "b_x": [float(centre[0])], "b_y": [float(centre[1])], "r": [float(radius)]})

    own = points.where("cell is not null and x is not null and y is not null").select(F.col("cell").cast("int").alias("cell"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    balls = hull_corners(own, "cell").groupBy("cell").applyInArrow(run, "cell int, b_x double, b_y double, r double")
    near = edges.select(F.col("i").alias("cell"), "j").join(balls, "cell").join(own.withColumnRenamed("cell", "j"), "j")
    foreign = near.groupBy("cell").agg(F.min(F.hypot(F.col("x") - F.col("b_x"), F.col("y") - F.col("b_y"))).alias("d"))
    r = F.greatest("r", F.coalesce("d", "r"))
    volume = F.lit(np.pi) * r * r if dim == 2 else F.lit(4 / 3 * np.pi) * r * r * r
    return balls.join(foreign, "cell", "left").select("cell", r.alias("radius"), volume.alias("volume"))


def density(counts: DataFrame, volumes: DataFrame, scale: float = 1.0, least: float = 0.0) -> DataFrame:
    """Points per volume; cells of no more than the least volume have none."""
    v = F.when(F.col("volume") > least, F.col("volume"))
    return counts.join(volumes.select("cell", "volume"), "cell").select("cell", (F.col("k") / v * scale).alias("density"))


def truth(cells: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Known fields, as expressions of c_x and c_y, at the cells' centres."""
    return cells.select("cell", *(e.alias(k) for k, e in fields.items()))
