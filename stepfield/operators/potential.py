"""Diffusivity and potential of cells together (mode dv), by matrix-free conjugate gradients on the edge table.

The cost is  sum over cells of  k log(scale) + |steps + D dt grad V|^2 / (4 scale)  with scale = D dt + sigma2, plus v_prior and d_prior times
the squared differences of V and of D, once for each pair of neighbours. grad V is the least-squares plane through a cell's neighbours.
V and D are settled in turn: given D, the cost is quadratic in V, whose matrix is only ever applied, by two joins with the edge table;
given V and the neighbours' D, a cell's D is found by bisection in one expression. The driver sees two sums a step of conjugate gradients and one
number a round; no cell's row, and no matrix over cells, is ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.sources.storage import stored

SIGMA2, SWEEPS = 0.03**2, 4
Operator = Callable[[DataFrame], DataFrame]


def gradient_weights(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, wx, wy): the gradient at i of a map f is the sum over j of w (f_j - f_i), by least squares; of least norm where neighbours lie in a line."""
    at = lambda k: cells.select(F.col("cell").alias(k), F.col("c_x").alias(f"{k}x"), F.col("c_y").alias(f"{k}y"))
    e = edges.select("i", "j").where("i <> j").distinct().join(at("i"), "i").join(at("j"), "j")
    e = e.select("i", "j", (F.col("jx") - F.col("ix")).alias("dx"), (F.col("jy") - F.col("iy")).alias("dy"))
    dx, dy, xx, xy, yy = (F.col(c) for c in ("dx", "dy", "xx", "xy", "yy"))
    sums = e.groupBy("i").agg(F.sum(dx * dx).alias("xx"), F.sum(dx * dy).alias("xy"), F.sum(dy * dy).alias("yy"))
    size, det = xx + yy, xx * yy - xy * xy
    line = det <= 1e-12 * size * size
    wx = F.when(line, (xx * dx + xy * dy) / (size * size)).otherwise((yy * dx - xy * dy) / det)
    wy = F.when(line, (xy * dx + yy * dy) / (size * size)).otherwise((xx * dy - xy * dx) / det)
    return e.join(sums, "i").select("i", "j", wx.alias("wx"), wy.alias("wy"))


def gradients(values: DataFrame, weights: DataFrame, value: str) -> DataFrame:
    """(cell, gx, gy) of a map (cell, value)."""
    at = lambda k: values.select(F.col("cell").alias(k), F.col(value).alias(f"v{k}"))
    rise = F.col("vj") - F.col("vi")
    return weights.join(at("j"), "j").join(at("i"), "i").groupBy(F.col("i").alias("cell")).agg(F.sum(F.col("wx") * rise).alias("gx"), F.sum(F.col("wy") * rise).alias("gy"))


def conjugate_gradients(operator: Operator, rhs: DataFrame, start: DataFrame | None = None, tolerance: float = 1e-6, steps: int = 500) -> DataFrame:
    """The x of operator(x) = b: rhs (cell, b), start (cell, x) -> (cell, x). operator takes (cell, p) to (cell, ap) and is symmetric and not
    negative; b lies in its range. One sum of products a step decides both its length and the next direction, so a step is one written
    table and one aggregate. Ends when the residual is `tolerance` of b, and raises if `steps` don't do it."""
    at = rhs.select("cell", "b", F.lit(0.0).alias("x"), F.col("b").alias("r"))
    if start is not None:
        moved = operator(start.select("cell", F.col("x").alias("p")))
        at = rhs.join(start.select("cell", "x"), "cell").join(moved, "cell").select("cell", "b", "x", (F.col("b") - F.col("ap")).alias("r"))
    at = at.select("cell", "b", "x", "r", F.lit(0.0).alias("p"), F.lit(0.0).alias("s"))

    def judged(state: DataFrame) -> DataFrame:
        return stored(state.join(operator(state.select("cell", F.col("r").alias("p"))).withColumnRenamed("ap", "w"), "cell"))

    state, before = judged(at), None
    r, w, p, s = (F.col(c) for c in "rwps")
    for _ in range(steps):
        rr, rw, bb = state.agg(F.sum(r * r), F.sum(r * w), F.sum(F.col("b") * F.col("b"))).first()
        if not rr or rr <= tolerance**2 * bb:
            return state.select("cell", "x")
        turn = rr / before[0] if before else 0.0
        length = rr / (rw - turn * rr / before[1]) if before else rr / rw
        if not math.isfinite(length) or length <= 0:
            raise ArithmeticError("the operator is not positive along a direction")
        before = rr, length
        turned = state.select("cell", "b", "x", "r", (r + turn * p).alias("p"), (w + turn * s).alias("s"))
        state = judged(turned.select("cell", "b", (F.col("x") + length * p).alias("x"), (r - length * s).alias("r"), "p", "s"))
    raise RuntimeError(f"no solution within {steps} steps")


def _potential_operator(own: DataFrame, links: DataFrame, v_prior: float) -> Operator:
    """(cell, p) -> (cell, ap): G' W G p + 2 v_prior L p in the scaled unknowns, G the gradient and L the graph's Laplacian. own has cell,
    k_x, k_y (sums of a cell's own gradient weights), degree, weight (W) and unit (the scale of its unknown)."""

    def apply(x: DataFrame) -> DataFrame:
        p = own.join(x, "cell").withColumn("p", F.col("p") * F.col("unit")).select("cell", "p")
        near = links.join(p.select(F.col("cell").alias("j"), "p"), "j").groupBy(F.col("i").alias("cell")).agg(F.sum(F.col("wx") * F.col("p")).alias("nx"), F.sum(F.col("wy") * F.col("p")).alias("ny"), F.sum("p").alias("np"))
        q = own.join(p, "cell").join(near, "cell", "left").fillna(0.0, ["nx", "ny", "np"])
        q = q.select("cell", "k_x", "k_y", "unit", *((F.col("weight") * (F.col(f"n{a}") - F.col(f"k_{a}") * F.col("p"))).alias(f"q{a}") for a in "xy"), (F.col("degree") * F.col("p") - F.col("np")).alias("lap"))
        back = links.join(q.select(F.col("cell").alias("i"), "qx", "qy"), "i").groupBy(F.col("j").alias("cell")).agg(F.sum(F.col("wx") * F.col("qx") + F.col("wy") * F.col("qy")).alias("back"))
        ap = F.coalesce("back", F.lit(0.0)) - F.col("k_x") * F.col("qx") - F.col("k_y") * F.col("qy") + 2 * v_prior * F.col("lap")
        return q.join(back, "cell", "left").select("cell", (ap * F.col("unit")).alias("ap"))

    return apply


def _potential(own: DataFrame, links: DataFrame, now: DataFrame, v_prior: float, sigma2: float, tolerance: float) -> DataFrame:
    """(cell, v): the potential that minimises the cost, given now (cell, d, v)."""
    u, scale = F.col("d") * F.col("dt"), F.col("d") * F.col("dt") + sigma2
    weighed = own.join(now, "cell").withColumns({"weight": F.col("k") * u * u / (2 * scale), "bx": -u * F.col("m_x") / (2 * scale), "by": -u * F.col("m_y") / (2 * scale)})
    of = links.join(weighed.select(F.col("cell").alias("i"), "weight", "bx", "by"), "i").groupBy(F.col("j").alias("cell"))
    sums = of.agg(F.sum(F.col("weight") * (F.col("wx") ** 2 + F.col("wy") ** 2)).alias("far"), F.sum(F.col("wx") * F.col("bx") + F.col("wy") * F.col("by")).alias("b"))
    size = F.coalesce("far", F.lit(0.0)) + F.col("weight") * (F.col("k_x") ** 2 + F.col("k_y") ** 2) + 2 * v_prior * F.col("degree")
    made = weighed.join(sums, "cell", "left").withColumn("unit", F.when(size > 0, 1 / F.sqrt(size)).otherwise(1.0))
    b = (F.coalesce("b", F.lit(0.0)) - F.col("k_x") * F.col("bx") - F.col("k_y") * F.col("by")) * F.col("unit")
    made = stored(made.select("cell", "k_x", "k_y", "degree", "weight", "unit", "v", b.alias("b")))
    apply = _potential_operator(made.select("cell", "k_x", "k_y", "degree", "weight", "unit"), links, v_prior)
    x = conjugate_gradients(apply, made.select("cell", "b"), made.select("cell", (F.col("v") / F.col("unit")).alias("x")), tolerance)
    return made.select("cell", "unit").join(x, "cell").select("cell", (F.col("x") * F.col("unit")).alias("v"))


def _diffusivities(own: DataFrame, links: DataFrame, slopes: DataFrame, now: DataFrame, d_prior: float, sigma2: float) -> DataFrame:
    """now (cell, d) after SWEEPS rounds in which every cell settles its d, given its neighbours' last ones and slopes (cell, gx, gy)."""
    mid, s2 = "((b.low + b.high) / 2)", f"{sigma2!r}D"
    u, scale = f"({mid} * dt)", f"({mid} * dt + {s2})"
    rising = f"4 * k * {scale} - s + 2 * mg * {s2} + k * g2 * ({u} * {u} + 2 * {u} * {s2}) + 8 * w * ({mid} - near) * {scale} * {scale} / dt"
    start = f"named_struct('low', 0D, 'high', greatest(near, (s - 2 * mg * {s2}) / (4 * k * dt), 1e-12D))"
    step = f"(b, n) -> if({rising} > 0, named_struct('low', b.low, 'high', {mid}), named_struct('low', {mid}, 'high', b.high))"
    settled = F.expr(f"aggregate(sequence(1, 60), {start}, {step}, b -> {mid})")
    fixed = own.join(slopes, "cell", "left").fillna(0.0, ["gx", "gy"])
    fixed = fixed.select("cell", "k", "s", "dt", (F.col("m_x") * F.col("gx") + F.col("m_y") * F.col("gy")).alias("mg"), (F.col("gx") ** 2 + F.col("gy") ** 2).alias("g2"), (d_prior * F.col("degree")).alias("w"))
    for _ in range(SWEEPS if d_prior else 1):
        near = links.select("i", "j").join(now.select(F.col("cell").alias("j"), "d"), "j").groupBy(F.col("i").alias("cell")).agg(F.avg("d").alias("near"))
        now = fixed.join(near, "cell", "left").fillna(0.0, ["near"]).select("cell", settled.alias("d"))
    return now


def infer_dv(cells: DataFrame, edges: DataFrame, v_prior: float = 0.05, d_prior: float = 0.05, sigma2: float = SIGMA2, rounds: int = 60, tolerance: float = 1e-3) -> DataFrame:
    """Cells with statistics() and c_x, c_y, and edges (i, j) in both directions -> (cell, diffusivity, potential, force_x, force_y). The least
    potential is 0 and the force its gradient downwards. Cells without steps have no row, and their edges don't count. Ends when no D and no V
    moves by more than `tolerance` of the largest one in a round; raises if `rounds` don't settle it."""
    some = cells.where("k > 0").select("cell", F.col("k").cast("double").alias("k"), "dt", "m_x", "m_y", F.col("s").cast("double").alias("s"), "c_x", "c_y")
    links = stored(gradient_weights(some, edges))
    sums = links.groupBy(F.col("i").alias("cell")).agg(F.sum("wx").alias("k_x"), F.sum("wy").alias("k_y"), F.count("*").cast("double").alias("degree"))
    own = stored(some.join(sums, "cell", "left").fillna(0.0, ["k_x", "k_y", "degree"]))
    first = F.greatest((F.col("s") / (4 * F.col("k")) - sigma2) / F.col("dt"), F.lit(1e-12))
    now = stored(own.select("cell", first.alias("d"), F.lit(0.0).alias("v")))
    for n in range(rounds):
        exact = max(tolerance, 0.1 ** (n + 1))  # V needn't be more exact than D is by now
        v = stored(_potential(own, links, now, v_prior, sigma2, exact))
        d = _diffusivities(own, links, gradients(v, links, "v"), now.select("cell", "d"), d_prior, sigma2)
        last = now.select("cell", F.col("d").alias("d_before"), F.col("v").alias("v_before"))
        now = stored(d.join(v, "cell").join(last, "cell"))
        size = now.agg(*(F.max(F.abs(F.col(c) - F.col(f"{c}_before"))) for c in "dv"), F.max("d"), F.max("v") - F.min("v")).first()
        now = now.select("cell", "d", "v")
        if size[0] is None or (exact == tolerance and size[0] <= tolerance * size[2] and size[1] <= tolerance * size[3]):
            break
    else:
        raise RuntimeError(f"diffusivities and potentials not settled after {rounds} rounds")
    least = now.agg(F.min("v")).first()[0] or 0.0
    out = now.join(gradients(now, links, "v"), "cell", "left").fillna(0.0, ["gx", "gy"])
    return out.select("cell", F.col("d").alias("diffusivity"), (F.col("v") - least).alias("potential"), (-F.col("gx")).alias("force_x"), (-F.col("gy")).alias("force_y"))
