"""Evidence for a force and posteriors of the force and the diffusivity, per cell.

Every function works on arrays, one entry for each row of an Arrow batch: integrals over the share l of the spurious force are Gauss-Legendre sums on
all rows' nodes at once, roots and intervals are bracketed and bisected for all rows together. Rows are independent, so operators are map passes
without a shuffle; rows whose inputs are null, NaN or of no variance get nulls."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
_lgamma = np.vectorize(math.lgamma, otypes=[float])
#: Columns that all operators read, and rows worked on at once, which bounds memory: 64 nodes on four pieces of [0, 1] take 2 kB a row.
_INPUTS = ("zeta_x", "zeta_y", "spurious_x", "spurious_y", "k", "variance", "prior_variance")
ROWS = 4096


def log_gammainc(p, x):
    """Log of the regularised lower incomplete gamma function: its series below p + 1, else one minus a continued fraction."""
    p, x = np.broadcast_arrays(np.asarray(p, float), np.asarray(x, float))
    out = np.full(x.shape, -np.inf)
    out[np.isposinf(x)] = 0.0
    low, high = (x > 0) & (x < p + 1), (x >= p + 1) & np.isfinite(x)
    front = lambda a, b: a * np.log(b) - b - _lgamma(a)
    if low.any():
        a, b = p[low], x[low]
        k, term = a.copy(), 1 / a
        total = term.copy()
        while (term > total * 1e-16).any():
            k += 1
            term = term * b / k
            total += term
        out[low] = front(a, b) + np.log(total)
    if high.any():
        a, b = p[high], x[high]
        n, c = b + 1 - a, np.full(b.shape, 1e300)
        d = 1 / n
        h = d.copy()
        safe = lambda v: np.where(v == 0, 1e-300, v)
        for i in range(1, 10_000):
            m, n = -i * (i - a), n + 2
            d, c = 1 / safe(m * d + n), safe(n + m / c)
            h *= d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = np.log1p(-np.minimum(np.exp(front(a, b)) * h, 1 - 1e-16))
    return out if out.ndim else float(out)


def pseudo_steps(dim: int) -> int:
    """Weight of the prior in steps."""
    return 5 - dim


def shape(k, dim: int = 2):
    return dim * (k + pseudo_steps(dim) - 1) / 2 - 1


def _log_integral(q: Callable, p, rel, share: float | None = None) -> np.ndarray:
    """Log of the integral over l in [0, 1] of q(l)^-p gammainc(p, rel q(l)), for all rows; q is quadratic in l. [0, 1] is cut where q^-p has fallen to e^-36 of
    its peak, so that narrow peaks, of cells of many steps, get all nodes of a piece. With a `share`, the logarithm of the integrand there."""
    log_f = lambda l: -p[:, None] * np.log(q(l)) + (log_gammainc(p[:, None], rel[:, None] * q(l)) if np.isfinite(rel).any() else 0.0)
    if share is not None:
        return log_f(np.full((len(p), 1), float(share)))[:, 0]
    q0, q1, half = (q(np.full((len(p), 1), l))[:, 0] for l in (0.0, 1.0, 0.5))
    with np.errstate(all="ignore"):
        bend = 2 * (q0 - 2 * half + q1)
        lean = q1 - q0 - bend
        peak = -lean / (2 * bend)
        near = np.clip(np.nan_to_num(peak, nan=0.5), 0, 1)
        reach = np.sqrt((q(near[:, None])[:, 0] * np.exp(36 / p) - q0 + lean * lean / (4 * bend)) / bend)
        cuts = [np.nan_to_num(c, nan=0.0, posinf=1.0, neginf=0.0) for c in (peak - reach, near, peak + reach)]
        edges = np.sort(np.clip(np.stack([np.zeros(len(p)), *cuts, np.ones(len(p))], 1), 0, 1), 1)
        a, width = edges[:, :-1, None], np.diff(edges, axis=1)[:, :, None]
        l = (a + width * (_NODES + 1) / 2).reshape(len(p), -1)
        f = log_f(l) + np.log(_WEIGHTS * width / 2).reshape(len(p), -1)
    top = f.max(1)
    return top + np.log(np.exp(f - top[:, None]).sum(1))


def _prior(k, variance, prior_variance, error: float, dim: int):
    """eta^2, v, p and the relative weight of the localisation error."""
    w = pseudo_steps(dim)
    rel = np.full(len(k), np.inf) if error == 0 else k * variance / (4 * error)
    return w / (k + w), 1 + w / k * prior_variance / variance, shape(k, dim), rel


def log10_factors(zt: list, zs: list, k, variance, prior_variance, error: float = 0.0, dim: int = 2) -> np.ndarray:
    """log10 of the evidence for a force over that for none, marginalised over the share of the spurious force. zt and zs are one array an axis."""
    eta2, v, p, rel = _prior(k, variance, prior_variance, error, dim)
    square = lambda l: sum((a[:, None] - l * b[:, None]) ** 2 for a, b in zip(zt, zs, strict=True))
    up, down = (_log_integral(lambda l, s=s: v[:, None] + s[:, None] * square(l), p, rel) for s in (eta2, np.ones(len(k))))
    return (up - down) / math.log(10) + dim * np.log10(eta2) / 2


def force_densities(at: list, zt: list, zs: list, k, variance, prior_variance, error: float = 0.0, share: float | None = None) -> np.ndarray:
    """Posterior density of the force zeta_a at a place of the plane, marginalised over the share of the spurious force or for a given one."""
    eta2, v, p, rel = _prior(k, variance, prior_variance, error, 2)
    away = lambda l: sum((a[:, None] - x[:, None] - l * b[:, None]) ** 2 for a, b, x in zip(zt, zs, at, strict=True))
    centred = lambda l: sum((a[:, None] - l * b[:, None]) ** 2 for a, b in zip(zt, zs, strict=True))
    own = v + eta2 / (1 - eta2) * sum(x * x for x in at)
    up = _log_integral(lambda l: own[:, None] + away(l), p + 1, rel, share)
    down = _log_integral(lambda l: v[:, None] + eta2[:, None] * centred(l), p, rel, share)
    return np.exp(up - down + np.log(p)) / (np.pi * (1 - eta2))


def axis_densities(at, zt: list, zs: list, k, variance, prior_variance, error: float = 0.0, share: float | None = None) -> np.ndarray:
    """Posterior density of the force along the first axis given, the other one being integrated out."""
    eta2, v, p, rel = _prior(k, variance, prior_variance, error, 2)
    off = lambda l, axis: zt[axis][:, None] - l * zs[axis][:, None]
    own = v + eta2 / (1 - eta2) * at * at
    up = _log_integral(lambda l: own[:, None] + (off(l, 0) - at[:, None]) ** 2 + eta2[:, None] * off(l, 1) ** 2, p + 0.5, rel, share)
    down = _log_integral(lambda l: v[:, None] + eta2[:, None] * (off(l, 0) ** 2 + off(l, 1) ** 2), p, rel, share)
    return np.exp(up - down + _lgamma(p + 0.5) - _lgamma(p)) / np.sqrt(np.pi * (1 - eta2))


def axis_prior(at, prior_variance, error: float = 0.0) -> np.ndarray:
    """Prior density of the force along an axis of the plane."""
    w = pseudo_steps(2)
    at, p = np.asarray(at, float), float(w - 2)
    q = 1 + at * at
    out = -(p + 0.5) * np.log(q) + math.lgamma(p + 0.5) - math.lgamma(p) - math.log(math.pi) / 2
    if error > 0:
        rel = w * np.asarray(prior_variance, float) / (4 * error)
        out = out + log_gammainc(p + 0.5, rel * q) - log_gammainc(p, rel)
    return np.exp(out)


def total_force_roots(zs_along, zt_across, k, variance, prior_variance, factor: float, error: float = 0.0, dim: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The two total forces along the spurious one at which the evidence equals a factor, for a part of the total force across it. The evidence is least halfway
    along the spurious force and grows to both sides; where it is above the factor even there, or stays below it however far, there are none (NaN)."""
    zero = np.zeros(len(k))
    lg = lambda x: log10_factors([x, zt_across], [zs_along, zero], k, variance, prior_variance, error, dim) - math.log10(factor)
    middle = zs_along / 2
    valid = lg(middle) <= 0
    roots = []
    for side in (-1.0, 1.0):
        step = np.maximum(np.abs(zs_along) / 2, 1e-3)
        for _ in range(50):
            short = valid & (lg(middle + side * step) < 0)
            if not short.any():
                break
            step = np.where(short, step * 2, step)
        near, far = zero.copy(), step
        for _ in range(100):
            mid = (near + far) / 2
            below = lg(middle + side * mid) < 0
            near, far = np.where(below, mid, near), np.where(below, far, mid)
        ok = valid & (lg(middle + side * step) >= 0)
        roots.append(np.where(ok, middle + side * (near + far) / 2, np.nan))
    return roots[0], roots[1]


def minimal_counts(zt: list, zs: list, k, variance, prior_variance, error: float = 0.0, dim: int = 2, threshold: float = 10.0) -> np.ndarray:
    """The least numbers of steps, from k on, at which the factor or its inverse reaches the threshold: doubling, then bisection; NaN if none."""
    need = math.log10(threshold)
    met = lambda n: np.abs(log10_factors(zt, zs, n, variance, prior_variance, error, dim)) >= need
    k = np.asarray(k, float)
    low, high = k.copy(), np.where(met(k), k, np.nan)
    for e in range(40):
        open_ = np.isnan(high)
        if not open_.any():
            break
        n = np.where(open_, k - 1 + 2.0**e, k)
        reached = met(n)
        high = np.where(open_ & reached, n, high)
        low = np.where(open_ & ~reached, np.maximum(low, n), low)
    while (wide := high - low > 1).any():
        mid = np.where(wide, np.floor((low + high) / 2), k)
        reached = met(mid)
        low, high = np.where(wide & ~reached, mid, low), np.where(wide & reached, mid, high)
    return high


def diffusivity_intervals(k, variance, prior_variance, norm2, dt: float, level: float = 0.95, error: float = 0.0, dim: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mode, low, high) of the conjugate posterior of D + error / dt, an inverse gamma law cut at the error; bounds by bisection of its distribution."""
    w = pseudo_steps(dim)
    g = 1 + w / k * prior_variance / variance + w / (k + w) * norm2
    p = shape(k, dim)
    rate = k * variance * g / (4 * dt)
    top = np.exp(log_gammainc(p, rate / (error / dt))) if error > 0 else np.ones(len(rate))
    below = lambda d: 1 - np.exp(log_gammainc(p, rate / (d + error / dt))) / top

    def solve(q: float) -> np.ndarray:
        low, high = 1e-12 * rate, rate / np.maximum(p, 1e-9)
        while (short := below(high) < q).any():
            high = np.where(short, high * 2, high)
        for _ in range(200):
            mid = (low + high) / 2
            under = below(mid) < q
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        return (low + high) / 2

    return rate / (p + 1) - error / dt, solve((1 - level) / 2), solve((1 + level) / 2)


def _one(f: Callable, *numbers):
    return f(*(np.array([float(x)]) for x in numbers))


def log10_factor(zeta_t, zeta_sp, k: float, variance: float, prior_variance: float, error: float = 0.0, dim: int = 2) -> float:
    """log10_factors() of one cell."""
    zt, zs = ([np.array([float(x)]) for x in z] for z in (zeta_t, zeta_sp))
    return float(_one(lambda *a: log10_factors(zt, zs, *a, error, dim), k, variance, prior_variance)[0])


def minimal_steps(zeta_t, zeta_sp, k: int, variance: float, prior_variance: float, error: float = 0.0, dim: int = 2, threshold: float = 10.0) -> float:
    """minimal_counts() of one cell."""
    zt, zs = ([np.array([float(x)]) for x in z] for z in (zeta_t, zeta_sp))
    return float(_one(lambda *a: minimal_counts(zt, zs, *a, error, dim, threshold), k, variance, prior_variance)[0])


def diffusivity_interval(k: float, variance: float, prior_variance: float, norm2: float, dt: float, level: float = 0.95, error: float = 0.0, dim: int = 2) -> tuple[float, float, float]:
    """diffusivity_intervals() of one cell."""
    return tuple(float(x[0]) for x in _one(lambda *a: diffusivity_intervals(*a, dt, level, error, dim), k, variance, prior_variance, norm2))


def _mapped(maps: DataFrame, inputs: tuple[str, ...], outputs: tuple[str, ...], f: Callable) -> DataFrame:
    """maps with columns from f(arrays of inputs), for rows whose inputs are numbers and whose variance is positive; null for the others."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                values = [b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs]
                ok = np.isfinite(np.stack(values)).all(0)
                for name, positive in zip(inputs, values, strict=True):
                    if name in ("variance", "k"):
                        ok &= np.nan_to_num(positive) > 0
                found = np.full((len(outputs), b.num_rows), np.nan)
                if ok.any():
                    found[:, ok] = f(*(v[ok] for v in values))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.float64(), from_pandas=True) for x in found)], names=[*b.schema.names, *outputs])

    return maps.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in maps.dtypes), *(f"{c} double" for c in outputs)]))


def bayes_factor(maps: DataFrame, error: float = 0.0, threshold: float = 10.0) -> DataFrame:
    """maps (k, variance, prior_variance, zeta_x, zeta_y, spurious_x, spurious_y) with lg_b and force (1, -1 or 0); null where an input is."""
    need = math.log10(threshold)
    out = _mapped(maps, _INPUTS, ("lg_b",), lambda tx, ty, sx, sy, *a: [log10_factors([tx, ty], [sx, sy], *a, error)])
    return out.withColumn("force", (F.col("lg_b") >= need).cast("int") - (F.col("lg_b") <= -need).cast("int"))


def minimal_n(maps: DataFrame, error: float = 0.0, threshold: float = 10.0) -> DataFrame:
    """bayes_factor() maps with min_n: the steps that a cell of such forces needs for evidence either way; null if 2^39 more are too few."""
    return _mapped(maps, _INPUTS, ("min_n",), lambda tx, ty, sx, sy, *a: [minimal_counts([tx, ty], [sx, sy], *a, error, threshold=threshold)])


def force_posterior(maps: DataFrame, error: float = 0.0, share: float | None = None) -> DataFrame:
    """maps with places a_x, a_y of the force, a row for each place: `posterior`, its density there. `share` fixes the part of the spurious force that the
    convention of the stochastic integral takes away; by default it is integrated out."""
    f = lambda ax, ay, tx, ty, sx, sy, *a: [force_densities([ax, ay], [tx, ty], [sx, sy], *a, error, share)]
    return _mapped(maps, ("a_x", "a_y", *_INPUTS), ("posterior",), f)


def force_posterior_along(maps: DataFrame, axis: str = "x", error: float = 0.0, share: float | None = None) -> DataFrame:
    """maps with places `a` of the force along an axis: `posterior` and `prior`, their densities there."""
    order = ("x", "y") if axis == "x" else ("y", "x")
    inputs = ("a", *(f"{z}_{c}" for z in ("zeta", "spurious") for c in order), "k", "variance", "prior_variance")
    f = lambda at, t0, t1, s0, s1, k, v, pv: [axis_densities(at, [t0, t1], [s0, s1], k, v, pv, error, share), axis_prior(at, pv, error)]
    return _mapped(maps, inputs, ("posterior", "prior"), f)


def force_roots(maps: DataFrame, factor: float, error: float = 0.0) -> DataFrame:
    """maps with spurious_along (along the spurious force) and zeta_across: the total forces root_low and root_high at which the evidence is `factor`, null
    where there are none."""
    inputs = ("spurious_along", "zeta_across", "k", "variance", "prior_variance")
    return _mapped(maps, inputs, ("root_low", "root_high"), lambda s, t, *a: total_force_roots(s, t, *a, factor, error))


def diffusivity_posterior(maps: DataFrame, dt: float, level: float = 0.95, error: float = 0.0) -> DataFrame:
    """snr() maps with the diffusivity's mode d_mode and the bounds d_low and d_high of its interval of a level."""
    f = lambda tx, ty, *a: diffusivity_intervals(*a, tx * tx + ty * ty, dt, level, error)
    return _mapped(maps, ("zeta_x", "zeta_y", "k", "variance", "prior_variance"), ("d_mode", "d_low", "d_high"), f)


def likeliest_share(zeta: tuple[str, str] = ("zeta_x", "zeta_y"), spurious: tuple[str, str] = ("spurious_x", "spurious_y")) -> Column:
    """The likeliest share of the spurious force, within [0, 1]; 0 without one."""
    dot = sum(F.col(a) * F.col(b) for a, b in zip(zeta, spurious, strict=True))
    norm2 = sum(F.col(b) * F.col(b) for b in spurious)
    return F.when(norm2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm2))).when(norm2 == 0, 0.0)
