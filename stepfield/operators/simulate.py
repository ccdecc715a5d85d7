"""Generators of trajectories: seeded per trajectory, so a lost task repeats its own walks exactly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "n long, row_id long, t double, x double, y double"


def brownian(spark: SparkSession, walks: int, length: int, diffusivity: float = 0.1, dt: float = 0.05, drift: tuple[float, float] = (0.0, 0.0), seed: int = 0) -> DataFrame:
    """Walks of constant diffusivity and drift in expressions alone: normal deviates hashed from (n, step), summed along the walk."""
    rows = spark.range(walks).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))

    def uniform(salt: int):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "n", "i"), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    radius = F.sqrt(-2 * F.log(uniform(1)))
    turn = 2 * np.pi * uniform(2)
    w = Window.partitionBy("n").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = (2 * diffusivity * dt) ** 0.5
    step = {c: F.when(F.col("i") == 0, 0.0).otherwise(v * dt + s * radius * f) for c, v, f in (("x", drift[0], F.cos(turn)), ("y", drift[1], F.sin(turn)))}
    return rows.select("n", (F.col("n") * length + F.col("i")).alias("row_id"), (F.col("i") * dt).alias("t"), "i", *(e.alias(c) for c, e in step.items())).withColumns({c: F.sum(c).over(w) for c in ("x", "y")}).drop("i")


def _walk(make: Callable, n: int, seed: int) -> np.ndarray:
    return make(np.random.default_rng([seed, n]))


def generate(spark: SparkSession, walks: int, make: Callable[[np.random.Generator], np.ndarray], dt: float = 0.05, seed: int = 0) -> DataFrame:
    """Walks from a function of a random generator that returns positions (rows of x, y). row_id holds n in its upper bits."""

    def run(batches):
        for b in batches:
            for n in b.column(0).to_pylist():
                p = _walk(make, n, seed)
                k = len(p)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, n)), pa.array((n << 24) + np.arange(k)), pa.array(np.arange(k) * dt), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["n", "row_id", "t", "x", "y"])

    return spark.range(walks).mapInArrow(run, SCHEMA)


def langevin(diffusivity: Callable, force: Callable, length: int, dt: float, start=(0.0, 0.0), box: tuple[float, float, float, float] | None = None) -> Callable:
    """Euler-Maruyama steps of dr = D F dt + sqrt(2 D) dW with D and F functions of x, y, t; a walk ends when it leaves the box."""

    def make(rng):
        p = [np.array(start, float)]
        for i in range(length - 1):
            d, f = diffusivity(*p[-1], i * dt), np.asarray(force(*p[-1], i * dt), float)
            q = p[-1] + d * f * dt + np.sqrt(2 * d * dt) * rng.standard_normal(2)
            if box and not (box[0] <= q[0] <= box[1] and box[2] <= q[1] <= box[3]):
                break
            p.append(q)
        return np.array(p)

    return make


def _summed(steps: np.ndarray) -> np.ndarray:
    return np.vstack([np.zeros(2), steps.cumsum(0)])


def _directions(rng, k: int) -> np.ndarray:
    a = rng.uniform(0, 2 * np.pi, k)
    return np.stack([np.cos(a), np.sin(a)], 1)


def random_steps(law: str, length: int, scale: float = 1.0) -> Callable:
    """Independent directions with step lengths that are exp, const, gauss or levy (Lomax of exponent 1.5)."""
    draw = {"exp": lambda r, k: r.exponential(scale, k), "const": lambda r, k: np.full(k, scale), "gauss": lambda r, k: np.abs(r.normal(0, scale, k)), "levy": lambda r, k: scale * r.pareto(1.5, k)}[law]
    return lambda rng: _summed(draw(rng, length - 1)[:, None] * _directions(rng, length - 1))


def waiting_times(length: int, exponent: float = 0.7, scale: float = 1.0) -> Callable:
    """Continuous-time random walk: heavy-tailed waits between Gaussian jumps, seen at regular times."""

    def make(rng):
        at = np.cumsum(1 + rng.pareto(exponent, length))
        jumps = _summed(rng.normal(0, scale, (length, 2)))
        return jumps[np.searchsorted(at, np.arange(length))]

    return make


def fractional(length: int, hurst: float, scale: float = 1.0) -> Callable:
    """Fractional Brownian motion from the Cholesky factor of its increments' covariance."""
    k = np.arange(length - 1, dtype=float)
    lag = np.abs(k[:, None] - k[None, :])
    factor = np.linalg.cholesky(0.5 * (np.abs(lag + 1) ** (2 * hurst) + np.abs(lag - 1) ** (2 * hurst) - 2 * lag ** (2 * hurst)) + 1e-12 * np.eye(length - 1))
    return lambda rng: _summed(scale * factor @ rng.standard_normal((length - 1, 2)))


def ornstein_uhlenbeck(length: int, relax: float, scale: float, dt: float) -> Callable:
    """Exact steps of a particle bound to the origin."""
    decay = np.exp(-dt / relax)

    def make(rng):
        p = np.zeros((length, 2))
        for i in range(1, length):
            p[i] = p[i - 1] * decay + scale * np.sqrt(1 - decay**2) * rng.standard_normal(2)
        return p

    return make


def switching(length: int, scales: tuple[float, ...], stay: float = 0.95) -> Callable:
    """Hidden states of different step scales; a state is kept with a given probability."""

    def make(rng):
        state, out = int(rng.integers(len(scales))), []
        for _ in range(length - 1):
            state = state if rng.random() < stay else int(rng.integers(len(scales)))
            out.append(scales[state] * rng.standard_normal(2))
        return _summed(np.array(out))

    return make


def confined(length: int, radius: float, scale: float) -> Callable:
    """Steps that would leave a disc are not taken."""

    def make(rng):
        p = np.zeros((length, 2))
        for i in range(1, length):
            q = p[i - 1] + scale * rng.standard_normal(2)
            p[i] = q if np.hypot(*q) <= radius else p[i - 1]
        return p

    return make


def diffusing_diffusivity(length: int, relax: float, scale: float) -> Callable:
    """The root of the diffusivity is itself an Ornstein-Uhlenbeck process."""
    root = ornstein_uhlenbeck(length, relax, scale, 1.0)
    return lambda rng: _summed(np.abs(root(rng)[1:, :1]) * rng.standard_normal((length - 1, 2)))


def self_avoiding(length: int) -> Callable:
    """Steps on a lattice to places not seen yet; the walk ends where there is none."""

    def make(rng):
        p, seen = [(0, 0)], {(0, 0)}
        while len(p) < length:
            free = [q for d in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (q := (p[-1][0] + d[0], p[-1][1] + d[1])) not in seen]
            if not free:
                break
            p.append(free[int(rng.integers(len(free)))])
            seen.add(p[-1])
        return np.array(p, float)

    return make


def add_noise(df: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """Gaussian localisation error."""
    return df.withColumns({c: F.col(c) + sigma * F.randn(seed + k) for k, c in enumerate(("x", "y"))})
