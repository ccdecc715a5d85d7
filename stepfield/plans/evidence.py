"""Queries on evidence for forces and on posteriors, per cell of the grid. Their twins integrate by Simpson's rule on 4001 nodes, enough for cells of
some thousand steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.operators import bayes as B
from stepfield.operators import derive as V
from stepfield.operators import graph as G
from stepfield.operators import infer as I
from stepfield.plans.common import CELLS, EDGES, GRID, r, rounded
from stepfield.plans.maps import _NEAR, _SIDES, _SNR, _moves, _slope
from stepfield.plans.registry import query

#: Per cell: total and spurious force, eta^2, v and p of the evidence, and the nodes.
_FORCES = (
    f", {CELLS}, {EDGES}, v AS (SELECT c.cell, c_x, c_y, volume, greatest(s / (4e0 * k) - 9e-4, 1e-16 - 9e-4) AS value FROM c JOIN m ON m.cell = c.cell), {_NEAR}, {_SIDES}, "
    f"z AS (SELECT q.cell, k, v, pv, zx, zy, coalesce({_slope('x')}, 0) / sqrt(v) AS sx, coalesce({_slope('y')}, 0) / sqrt(v) AS sy, 3e0 / (k + 3) AS eta2, 1 + 3e0 / k * pv / v AS v0, k + 1e0 AS p FROM q LEFT JOIN y ON y.cell = q.cell WHERE k > 1), "
    "n AS (SELECT i / 4000e0 AS l, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 12000e0 AS w FROM range(4001) r(i)) "
)
_D2 = "((zx - l * sx) ** 2 + (zy - l * sy) ** 2)"


def _logs(up: str, down: str, table: str, keys: str, keep: str) -> str:
    """Logs of the integrals of two integrands given as logs, per key."""
    return (
        f"f AS (SELECT {keys}, {keep}, w, {up} AS lu, {down} AS ld FROM {table}, n), s AS (SELECT *, max(lu) OVER k AS mu, max(ld) OVER k AS md FROM f WINDOW k AS (PARTITION BY {keys})), "
        f"b AS (SELECT {keys}, {', '.join(f'any_value({c}) AS {c}' for c in keep.split(', '))}, any_value(mu) + ln(sum(w * exp(lu - mu))) AS lu, any_value(md) + ln(sum(w * exp(ld - md))) AS ld FROM s GROUP BY {keys}) "
    )


_EVIDENCE = _SNR + _FORCES + ", " + _logs(f"-p * ln(v0 + eta2 * {_D2})", f"-p * ln(v0 + {_D2})", "z", "cell", "k, eta2") + ", l AS (SELECT cell, k, (lu - ld) / ln(10) + log10(eta2) AS lg_b FROM b) "


def _forces(spark, sf):
    """Total and spurious forces of cells of more than one step, the spurious one from the gradient of the diffusivity."""
    m = I.snr(_moves(spark, sf)).where("k > 1")
    d = I.infer_d(_moves(spark, sf)).select("cell", "diffusivity").join(GRID.cells(spark), "cell")
    both = m.join(V.gradient(d, G.grid_edges(spark, 10, 5), "diffusivity"), "cell", "left").fillna(0.0, ["grad_x", "grad_y"])
    return I.spurious_zeta(both, 1.0)


@query(_EVIDENCE + f"SELECT cell, k, {r('lg_b', digits=4)}, CAST(lg_b >= 1 AS INT) - CAST(lg_b <= -1 AS INT) AS force FROM l")
def bayes_factors(spark, sf):
    """Evidence for a force in each cell, from the step and the diffusivity gradient's signal-to-noise ratios."""
    return rounded(B.bayes_factor(_forces(spark, sf)).select("cell", "k", "lg_b", "force"), 4)


@query(
    _EVIDENCE.replace("WITH ", "WITH RECURSIVE ", 1) + ", h AS MATERIALIZED (SELECT e.i, e.j FROM e JOIN l a ON a.cell = e.i JOIN l b ON b.cell = e.j WHERE sign(a.lg_b) = sign(b.lg_b)), "
    "t AS (SELECT cell AS i, cell AS j FROM l UNION SELECT t.i, h.j FROM t JOIN h ON h.i = t.j), u AS (SELECT i AS cell, min(j) AS region FROM t GROUP BY i) "
    f"SELECT cell, region, {r('sum(lg_b) OVER (PARTITION BY region)', 'evidence', 4)} FROM u JOIN l USING (cell)"
)
def force_groups(spark, sf):
    """Groups of adjacent cells whose evidence (lg_b) has the same sign, and its sum."""
    m = B.bayes_factor(_forces(spark, sf)).select("cell", F.col("lg_b").alias("value"))
    groups = G.sign_groups(G.grid_edges(spark, 10, 5), m)
    return rounded(I.group_sum(m, groups, "value").select("cell", F.col("group").alias("region"), F.col("group_value").alias("evidence")), 4)


_AT = "a AS (SELECT z.*, u, w2, zx + u / sqrt(k) AS ax, zy + w2 / sqrt(k) AS ay FROM z, (SELECT CAST(i AS INT) AS u FROM range(-2, 3) r(i)), (SELECT CAST(i AS INT) AS w2 FROM range(-2, 3) r(i))), "
_AWAY = "((zx - ax - l * sx) ** 2 + (zy - ay - l * sy) ** 2)"


@query(
    _SNR + _FORCES + ", " + _AT + _logs(f"-(p + 1) * ln(v0 + eta2 / (1 - eta2) * (ax * ax + ay * ay) + {_AWAY})", f"-p * ln(v0 + eta2 * {_D2})", "a", "cell, u, w2", "p, eta2")
    + f"SELECT cell, u, w2 AS v, {r('exp(lu - ld) * p / (pi() * (1 - eta2))', 'posterior', 4)} FROM b"
)
def force_posteriors(spark, sf):
    """Posterior density of the force on 25 places about each cell's total force, in units of its standard error."""
    steps = F.array(*(F.lit(i) for i in range(-2, 3)))
    at = _forces(spark, sf).withColumn("u", F.explode(steps)).withColumn("v", F.explode(steps))
    at = at.withColumns({f"a_{c}": F.col(f"zeta_{c}") + F.col(i) / F.sqrt("k") for c, i in (("x", "u"), ("y", "v"))})
    return rounded(B.force_posterior(at).select("cell", "u", "v", "posterior"), 4)


@query(
    _SNR + _FORCES + ", a AS (SELECT z.*, u, zx + u / sqrt(k) AS ax FROM z, (SELECT CAST(i AS INT) AS u FROM range(-3, 4) r(i))), "
    + _logs("-(p + 0.5e0) * ln(v0 + eta2 / (1 - eta2) * ax * ax + (zx - ax - l * sx) ** 2 + eta2 * (zy - l * sy) ** 2)", f"-p * ln(v0 + eta2 * {_D2})", "a", "cell, u", "p, eta2, ax")
    + f"SELECT cell, u, {r('exp(lu - ld + lgamma(p + 0.5e0) - lgamma(p)) / sqrt(pi() * (1 - eta2))', 'posterior')}, {r('exp(-1.5e0 * ln(1 + ax * ax) + lgamma(1.5e0) - ln(pi()) / 2)', 'prior')} FROM b"
)
def axis_posteriors(spark, sf):
    """Posterior and prior densities of the force along x on seven places about each cell's total force."""
    at = _forces(spark, sf).withColumn("u", F.explode(F.array(*(F.lit(i) for i in range(-3, 4)))))
    at = at.withColumn("a", F.col("zeta_x") + F.col("u") / F.sqrt("k"))
    return rounded(B.force_posterior_along(at).select("cell", "u", "posterior", "prior"))


@query(_SNR + _FORCES + f"SELECT cell, {r('CASE WHEN sx = 0 AND sy = 0 THEN 0 ELSE greatest(0, least(1, (zx * sx + zy * sy) / (sx * sx + sy * sy))) END', 'share')} FROM z")
def likeliest_shares(spark, sf):
    """The likeliest share of the spurious force in each cell."""
    return rounded(_forces(spark, sf).select("cell", B.likeliest_share().alias("share")))


@query()
def steps_for_evidence(spark, sf):
    """How many steps each cell would need for evidence either way. No SQL: doubling and bisection; tested against a count from k upwards."""
    return rounded(B.minimal_n(_forces(spark, sf)).select("cell", "k", "min_n"))


@query()
def evidence_bounds(spark, sf):
    """Total forces, were they along the spurious one, between which the evidence speaks against a force by a factor of two. No SQL: bracketed roots; tested by what the
    evidence is there."""
    m = _forces(spark, sf).withColumns({"spurious_along": F.hypot("spurious_x", "spurious_y"), "zeta_across": F.lit(0.0)})
    return rounded(B.force_roots(m, 0.5).select("cell", "root_low", "root_high"))


@query()
def diffusivity_intervals(spark, sf):
    """Mode and 95 % interval of each cell's diffusivity. No SQL: bounds by bisection; tested by numerical integration of the density."""
    return rounded(B.diffusivity_posterior(I.snr(_moves(spark, sf)).where("k > 1"), 1.0).select("cell", "d_mode", "d_low", "d_high"), 3)
