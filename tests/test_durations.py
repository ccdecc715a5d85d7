"""Steps of unequal durations against one cell at a time; Student's distribution against known values; edges against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import durations, edgetest, infer


def one_cell(dx: np.ndarray, dy: np.ndarray, dt: np.ndarray, sigma2: float, mode: str, jeffreys: bool) -> tuple[float, float, float]:
    """(D, drift x, drift y) for steps of any durations: bisection on log D of the profile posterior's slope, from a bracketing scan."""
    mean = dt.mean()

    def fit(d: float) -> tuple[float, float, float]:
        s = d * dt + sigma2
        w = 1 / s
        a = ((w * dt * dx).sum() / (w * dt * dt).sum(), (w * dt * dy).sum() / (w * dt * dt).sum()) if mode != "d" else (0.0, 0.0)
        cost = np.log(4 * np.pi * s).sum() + (((dx - a[0] * dt) ** 2 + (dy - a[1] * dt) ** 2) / (4 * s)).sum()
        if jeffreys:
            cost += 2 * np.log(d * mean + sigma2) - (2 * np.log(d) if mode == "df" else 0)
        return (cost, *a)

    rough = max((dx**2 + dy**2).sum() / (4 * dt.sum()), 1e-12)
    grid = np.geomspace(rough * 1e-6, rough * 1e2, 81)
    at = int(np.argmin([fit(d)[0] for d in grid]))
    low, high = np.log(grid[max(0, at - 1)]), np.log(grid[min(80, at + 1)])
    g = (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if fit(np.exp(a))[0] < fit(np.exp(b))[0] else (a, high)
    d = float(np.exp((low + high) / 2))
    return (d, *fit(d)[1:])


@pytest.mark.parametrize("mode,jeffreys,bits", [("d", False, 12), ("dd", False, 3), ("df", True, 4)])
def test_unequal_durations(spark, monkeypatch, mode, jeffreys, bits):
    monkeypatch.setattr(durations, "BLOCK_BITS", bits)
    rng = np.random.default_rng(8)
    rows = []
    for cell, size in ((0, 400), (1, 30), (7, 3)):
        for dt in rng.uniform(0.01, 0.3, size):
            dx, dy = rng.normal(0.4 * dt, np.sqrt(2 * 0.2 * (cell + 1) * dt), 2)
            rows.append((cell, float(dx), float(dy), float(dt)))
    odd = [(0, 1.0, 1.0, 0.0), (0, None, 1.0, 0.1), (9, 1.0, 1.0, -1.0), (None, 1.0, 1.0, 0.1)]
    steps = spark.createDataFrame(rows + odd, "cell int, dx double, dy double, dt double")
    got = {r.cell: r for r in infer.infer_any_dt(steps, mode, jeffreys=jeffreys).collect()}
    assert set(got) == {0, 1, 7}
    for cell, row in got.items():
        dx, dy, dt = np.array([r[1:] for r in rows if r[0] == cell]).T
        d, ax, ay = one_cell(dx, dy, dt, infer.SIGMA2, mode, jeffreys)
        if mode == "df":
            ax, ay = ax / d, ay / d
        assert row.k == len(dx)
        assert (row.diffusivity, row.a_x, row.a_y) == pytest.approx((d, ax, ay), rel=1e-6)


def test_no_steps(spark):
    steps = spark.createDataFrame([], "cell int, dx double, dy double, dt double")
    assert infer.infer_any_dt(steps).count() == 0


def test_student(spark):
    """Values of printed tables, and the closed forms for one and two degrees of freedom."""
    rows = [(12.706, 1.0, 0.05), (2.228, 10.0, 0.05), (4.587, 10.0, 0.001), (1.96, 1e6, 0.05), (0.0, 5.0, 1.0)]
    rows += [(t, 1.0, 1 - 2 * np.arctan(t) / np.pi) for t in (0.3, 2.0, 40.0)] + [(t, 2.0, 1 - t / np.sqrt(2 + t * t)) for t in (-0.0, 0.7, 5.0, 300.0)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "t double, freedom double, want double")
    for r in df.withColumn("p", edgetest.student_p(F.col("t"), F.col("freedom"))).collect():
        assert r.p == pytest.approx(r.want, rel=1e-3 if r.want in (0.05, 0.001) else 1e-5), r


def test_edges_against_a_loop(spark):
    rng = np.random.default_rng(2)
    points = [(c, float(x), float(y)) for c, m, size in ((0, 0.0, 30), (1, 1.0, 12), (2, 9.0, 5), (3, 20.0, 1)) for x, y in rng.normal((m, 0), 0.6, (size, 2))]
    points += [(4, 5.0, 5.0)] * 3 + [(5, 5.0, 5.0)] * 2 + [(6, 6.0, 5.0)] * 2 + [(0, None, 1.0)]
    assigned = spark.createDataFrame([(n, *p, "kept") for n, p in enumerate(points)], "row_id int, cell int, x double, y double, v string")
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3), (4, 5), (5, 6), (0, 0), (0, 1)], "i int, j int")
    got = {(r.i, r.j): r for r in edgetest.tested_edges(assigned, edges, 0.001).collect()}
    assert set(got) == {(0, 1), (1, 2), (4, 5), (5, 6)}
    assert got[4, 5].p == 1 and got[5, 6].p == 0 and got[0, 1].valid and not got[1, 2].valid
    for i, j in ((0, 1), (1, 2)):
        a, b = (np.array([p[1:] for p in points if p[0] == c and p[1] is not None]) for c in (i, j))
        line = b.mean(0) - a.mean(0)
        u, v = np.sort((a - a.mean(0)) @ line)[-10:], np.sort((b - a.mean(0)) @ line)[:10]
        s, w = u.var(ddof=1) / len(u), v.var(ddof=1) / len(v)
        t, freedom = (u.mean() - v.mean()) / np.sqrt(s + w), (s + w) ** 2 / (s**2 / (len(u) - 1) + w**2 / (len(v) - 1))
        row = got[i, j]
        assert (row.n_i, row.n_j) == (len(u), len(v)) and (row.t, row.freedom) == pytest.approx((t, freedom))
    assert edgetest.tested_edges(assigned.limit(0), edges).count() == 0
