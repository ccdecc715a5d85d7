"""Evidence and posteriors against fine sums over the share of the spurious force, and against their own laws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import bayes

MAPS = "cell int, k double, variance double, prior_variance double, zeta_x double, zeta_y double, spurious_x double, spurious_y double"
ROWS = [
    (0, 20.0, 0.64, 0.608, 0.7, 0.4, 0.8, 0.6),
    (1, 5.0, 0.5, 0.7, -0.3, 0.1, 0.0, 0.0),
    (2, 9000.0, 1.2, 1.0, 0.9, -0.2, -1.5, 0.7),  # a narrow peak at an end
    (3, 4000.0, 1.2, 1.0, 0.5, 0.25, 1.0, 0.5),  # and within
    (4, None, 1.0, 1.0, 0.1, 0.1, 0.1, 0.1),
    (5, 10.0, 0.0, 1.0, 0.1, 0.1, 0.1, 0.1),
    (6, 10.0, 1.0, 1.0, float("nan"), 0.1, 0.1, 0.1),
]


def slow(zt, zs, scale, v, p, nodes=200_000):
    """Log of the integral by the midpoint rule."""
    l = (np.arange(nodes) + 0.5) / nodes
    f = -p * np.log(v + scale * ((zt[0] - l * zs[0]) ** 2 + (zt[1] - l * zs[1]) ** 2))
    return f.max() + math.log(np.exp(f - f.max()).mean())


def slow_factor(row):
    _, k, variance, prior, zx, zy, sx, sy = row
    eta2, v, p = 3 / (k + 3), 1 + 3 / k * prior / variance, k + 1
    return (slow((zx, zy), (sx, sy), eta2, v, p) - slow((zx, zy), (sx, sy), 1.0, v, p)) / math.log(10) + math.log10(eta2)


def test_factors_by_fine_sums(spark):
    got = {r.cell: r for r in bayes.bayes_factor(spark.createDataFrame(ROWS, MAPS)).collect()}
    for row in ROWS[:4]:
        assert got[row[0]].lg_b == pytest.approx(slow_factor(row), rel=1e-6, abs=1e-6)
        assert got[row[0]].force == int(got[row[0]].lg_b >= 1) - int(got[row[0]].lg_b <= -1)
    assert all(got[c].lg_b is None and got[c].force is None for c in (4, 5, 6))


@pytest.mark.parametrize("share", [None, 0.5])
@pytest.mark.parametrize("error", [0.0, 0.01])
def test_posteriors_have_the_right_mass_and_margins(spark, share, error):
    one = spark.createDataFrame(ROWS[:1], MAPS)
    h = 0.05
    places = F.sequence(F.lit(-100), F.lit(100))
    plane = one.withColumn("i", F.explode(places)).withColumn("j", F.explode(places)).withColumns({"a_x": F.col("i") * h, "a_y": F.col("j") * h})
    found = bayes.force_posterior(plane, error, share).groupBy("i").agg((F.sum("posterior") * h).alias("p"))
    margin = {r.i: r.p for r in found.collect()}
    along = bayes.force_posterior_along(one.withColumn("i", F.explode(places)).withColumn("a", F.col("i") * h), "x", error, share)
    for r in along.collect():
        assert r.posterior == pytest.approx(margin[r.i], abs=1e-3 if error else 1e-6)
    assert sum(margin.values()) * h == pytest.approx(1, abs=1e-3)


def test_prior_is_a_density():
    at = np.linspace(-2000, 2000, 1_000_001)
    assert bayes.axis_prior(at, 1.0).sum() * (at[1] - at[0]) == pytest.approx(1, abs=1e-5)


def test_roots_hold_the_factor(spark):
    m = spark.createDataFrame(ROWS, MAPS).withColumns({"spurious_along": F.hypot("spurious_x", "spurious_y"), "zeta_across": F.lit(0.02)})
    for r in bayes.force_roots(m, 0.5).collect():
        if r.cell in (4, 5):
            assert r.root_low is None
        elif r.root_low is not None:
            assert (r.root_low + r.root_high) / 2 == pytest.approx(r.spurious_along / 2, abs=1e-9)
            for root in (r.root_low, r.root_high):
                assert bayes.log10_factor((root, 0.02), (r.spurious_along, 0.0), r.k, r.variance, r.prior_variance) == pytest.approx(math.log10(0.5), abs=1e-6)
    none = bayes.force_roots(m.where("cell = 0"), 1e-9).first()  # the evidence never gets so low
    assert none.root_low is None and none.root_high is None


def test_steps_needed_by_counting(spark):
    rows = [*ROWS[:2], (7, 3.0, 1.0, 1.0, 0.9, 0.5, 0.2, 0.1)]
    for r, row in zip(bayes.minimal_n(spark.createDataFrame(rows, MAPS)).orderBy("cell").collect(), rows, strict=True):
        n = next(n for n in range(int(row[1]), 10_000) if abs(bayes.log10_factor(row[4:6], row[6:8], n, row[2], row[3])) >= 1)
        assert r.min_n == n


def test_intervals_hold_their_share(spark):
    out = bayes.diffusivity_posterior(spark.createDataFrame(ROWS[:2], MAPS), 0.1, 0.9, 0.001).collect()
    for r in out:
        p = r.k + 1
        rate = r.k * r.variance * (1 + 3 / r.k * r.prior_variance / r.variance + 3 / (r.k + 3) * (r.zeta_x**2 + r.zeta_y**2)) / 0.4
        d = np.linspace(0, 60 * r.d_mode, 2_000_001)[1:]
        f = np.exp(-(p + 1) * np.log(d + 0.01) - rate / (d + 0.01))
        f /= f.sum()
        assert f[d <= r.d_low].sum() == pytest.approx(0.05, abs=1e-4) and f[d >= r.d_high].sum() == pytest.approx(0.05, abs=1e-3)
        assert abs(d[f.argmax()] - r.d_mode) < 1e-3 * r.d_mode


def test_no_cells(spark):
    none = spark.createDataFrame([], MAPS)
    assert bayes.bayes_factor(none).count() == 0 and bayes.minimal_n(none).count() == 0


def test_likeliest_share(spark):
    got = {r.cell: r.s for r in spark.createDataFrame(ROWS, MAPS).select("cell", bayes.likeliest_share().alias("s")).collect()}
    assert got[0] == pytest.approx(0.8) and got[1] == 0 and got[2] == 0 and got[3] == pytest.approx(0.5)
