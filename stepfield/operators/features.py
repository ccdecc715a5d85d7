"""Features of trajectories: one row per n. Lags are windows, never pairs of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.functions.columns import along
from stepfield.sources.storage import stored

LAGS = (1, 2, 3, 4, 5, 6, 8, 10)


def _stepped(df: DataFrame) -> DataFrame:
    w = along()
    return df.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)}).withColumn("step", F.hypot("dx", "dy"))


def step_moments(df: DataFrame) -> DataFrame:
    """Moments of step lengths (of the population; excess kurtosis)."""
    s = _stepped(df).where("step is not null")
    return s.groupBy("n").agg(F.avg("step").alias("step_mean"), F.var_pop("step").alias("step_var"), F.skewness("step").alias("step_skewness"), F.kurtosis("step").alias("step_kurtosis"), F.min("step").alias("step_min"), F.max("step").alias("step_max"))


def lagged(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """(n, lag, d2, dx, dy): squared displacements over each lag, in one window pass and one explode of a constant width."""
    w = along()
    d = [F.struct(F.lit(k).alias("lag"), (F.lead("x", k).over(w) - F.col("x")).alias("dx"), (F.lead("y", k).over(w) - F.col("y")).alias("dy")) for k in lags]
    return df.select("n", F.array(*d).alias("d")).select("n", F.explode("d").alias("d")).select("n", "d.*").where("dx is not null").withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))


def msd(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    return lagged(df, lags).groupBy("n", "lag").agg(F.count("*").alias("k"), F.avg("d2").alias("msd"))


def msd_fit(df: DataFrame, lags: Sequence[int] = LAGS, dt: float = 1.0) -> DataFrame:
    """Power law of the mean square displacement: exponent, correlation and diffusivity of log10-log10 regression."""
    m = msd(df, lags).where("msd > 0").select("n", F.log10(F.col("lag") * dt).alias("u"), F.log10("msd").alias("v"))
    return m.groupBy("n").agg(F.regr_slope("v", "u").alias("msd_alpha"), F.corr("u", "v").alias("msd_rval"), (F.pow(F.lit(10.0), F.regr_intercept("v", "u")) / 4).alias("msd_diffusion"))


def drift(df: DataFrame) -> DataFrame:
    """Norm of the mean velocity since the start."""
    w = along()
    at = {c: (F.col(c) - F.first(c).over(w)) / F.nullif(F.col("t") - F.first("t").over(w), F.lit(0.0)) for c in ("x", "y")}
    return df.select("n", at["x"].alias("vx"), at["y"].alias("vy")).groupBy("n").agg(F.hypot(F.avg("vx"), F.avg("vy")).alias("drift_norm"))


def displacement_pdf(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Moments of distances by lag."""
    d = lagged(df, lags).withColumn("d", F.sqrt("d2"))
    return d.groupBy("n", "lag").agg(F.avg("d").alias("d_mean"), F.var_pop("d").alias("d_var"), F.skewness("d").alias("d_skewness"), F.kurtosis("d").alias("d_kurtosis"))


def displacement_pdf_fit(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Power laws of the mean and the variance over lags; mean and variance of skewness and kurtosis over lags."""
    p = displacement_pdf(df, lags).withColumns({"u": F.log10("lag"), "a": F.when(F.col("d_mean") > 0, F.log10("d_mean")), "b": F.when(F.col("d_var") > 0, F.log10("d_var"))})
    out = [F.regr_slope("a", "u").alias("pdf_mean_alpha"), F.regr_slope("b", "u").alias("pdf_var_alpha")]
    out += [f(c).alias(f"pdf_{c[2:]}_{k}") for c in ("d_skewness", "d_kurtosis") for k, f in (("mean", F.avg), ("var", F.var_pop))]
    return p.groupBy("n").agg(*out)


def gyration(df: DataFrame) -> DataFrame:
    """Eigenvalues of the gyration tensor, asymmetry and asphericity, in closed form."""
    g = df.groupBy("n").agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    mid, half = (F.col("a") + F.col("b")) / 2, F.sqrt((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / 4 + F.col("c") * F.col("c"))
    g = g.withColumns({"l1": mid + half, "l2": F.greatest(mid - half, F.lit(0.0))})
    s, d = F.col("l1") + F.col("l2"), F.col("l1") - F.col("l2")
    ok = (s > 0) & (F.col("l2") > 0)
    return g.select("n", "l1", "l2", F.when(ok, -F.log(1 - d * d / (2 * s * s))).alias("asymmetry"), F.when(s > 0, d * d / (s * s)).alias("asphericity"))


def efficiency(df: DataFrame) -> DataFrame:
    """Net square displacement over the sum of squared steps, and net displacement over the path."""
    w = along()
    s = _stepped(df).withColumns({"x0": F.first("x").over(w), "y0": F.first("y").over(w)})
    e = s.groupBy("n").agg(F.max_by(F.struct("x", "y"), F.struct("t", "row_id")).alias("e"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.sum(F.col("step") * F.col("step")).alias("q"), F.sum("step").alias("p"))
    net = F.hypot(F.col("e.x") - F.col("x0"), F.col("e.y") - F.col("y0"))
    return e.select("n", F.when(F.col("q") > 0, net * net / F.col("q")).alias("efficiency"), F.when(F.col("p") > 0, net / F.col("p")).alias("straightness"))


def axis_kurtosis(df: DataFrame) -> DataFrame:
    """Fourth standardised moment of positions along the principal axis."""
    g = df.groupBy("n").agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    angle = F.atan2(2 * F.col("c"), F.col("a") - F.col("b")) / 2
    p = df.join(g.select("n", F.cos(angle).alias("u"), F.sin(angle).alias("v")), "n").select("n", (F.col("x") * F.col("u") + F.col("y") * F.col("v")).alias("p"))
    return p.groupBy("n").agg((F.kurtosis("p") + 3).alias("axis_kurtosis"))


def angles(df: DataFrame) -> DataFrame:
    """(n, row_id, angle): turning angle between a step and the next; null where a step has no length."""
    w = along()
    s = _stepped(df).withColumns({"ex": F.lead("dx").over(w), "ey": F.lead("dy").over(w)})
    dot, norm = F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey"), F.hypot("dx", "dy") * F.hypot("ex", "ey")
    return s.select("n", "row_id", "t", F.when(norm > 0, F.acos(F.greatest(F.least(dot / norm, F.lit(1.0)), F.lit(-1.0)))).alias("angle")).where("angle is not null")


def autocorrelation(df: DataFrame, column: str, lags: Sequence[int], prefix: str) -> DataFrame:
    """(n, var, ac1...): mean product of deviations k rows apart over the variance."""
    w, p = along(), Window.partitionBy("n")
    c = df.withColumns({"_d": F.col(column) - F.avg(column).over(p), "_v": F.var_pop(column).over(p)})
    c = c.withColumns({f"_p{k}": F.col("_d") * F.lead("_d", k).over(w) for k in lags})
    return c.groupBy("n").agg(F.first("_v").alias(f"{prefix}_var"), *(F.when(F.first("_v") > 0, F.avg(f"_p{k}") / F.first("_v")).alias(f"{prefix}_ac{k}") for k in lags))


def angle_features(df: DataFrame) -> DataFrame:
    return autocorrelation(angles(df), "angle", (1, 2), "angle")


def step_autocorrelation(df: DataFrame) -> DataFrame:
    return autocorrelation(_stepped(df).where("step is not null"), "step", (1, 2, 3), "step")


def gaussianity(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """<d^4> / <d^2>^2 - 1 by lag."""
    m = lagged(df, lags).groupBy("n", "lag").agg(F.avg(F.col("d2") * F.col("d2")).alias("q"), F.avg("d2").alias("p"))
    return m.where("p > 0").select("n", "lag", (F.col("q") / (F.col("p") * F.col("p")) - 1).alias("gaussianity"))


def gaussianity_features(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Mean over lags, and mean slope between successive lags."""
    w = Window.partitionBy("n").orderBy("lag")
    g = gaussianity(df, lags).withColumn("s", (F.col("gaussianity") - F.lag("gaussianity").over(w)) / (F.col("lag") - F.lag("lag").over(w)))
    return g.groupBy("n").agg(F.avg("gaussianity").alias("gaussianity_mean"), F.avg("s").alias("gaussianity_slope"))


def ergodicity(df: DataFrame, lag: int = 1, omega: float = 1.0) -> DataFrame:
    """Squared modulus of the mean of exp(i omega dx) over a lag, per axis: the characteristic function's estimator."""
    e = lagged(df, (lag,)).withColumns({"dx": F.col("dx") * omega, "dy": F.col("dy") * omega})
    return e.groupBy("n").agg(*((F.pow(F.avg(F.cos(c)), 2) + F.pow(F.avg(F.sin(c)), 2)).alias(f"ergodicity_{c[1]}") for c in ("dx", "dy")))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Batches sorted by keys, none of them null, dealt anew so that no group is cut; beside a batch only one group is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[-1] for k in keys]
        other = np.logical_or.reduce([pc.not_equal(b.column(k), v).to_numpy(zero_copy_only=False) for k, v in zip(keys, last, strict=True)])
        start = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if held and (start or [held[0].column(k)[0] for k in keys] != last):
            yield pa.Table.from_batches([*held, b.slice(0, start)]).combine_chunks()
            held = []
        elif start:
            yield pa.Table.from_batches([b.slice(0, start)])
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where the groups of a table sorted by keys begin."""
    changed = [pc.not_equal(table.column(k).slice(1), table.column(k).slice(0, len(table) - 1)).to_numpy() for k in keys]
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce(changed)]))


#: Rows of a trajectory's block in ergodicity_breaking are about seven to fourteen times as many, at most.
RESIDUES = 512


def _blocks(residues: int) -> Column:
    """Blocks of the row i of `size`, its own first. The lags are 0 to 6 times a sixth of the size, give or take a row, so a row and all that lie a lag later are nearly equal
    modulo that sixth: blocks are ranges of the remainder, and rows within two of a range's ends are in the next block as well."""
    sixth = F.greatest((F.col("size") - 2) / 6.0, F.lit(1.0))
    many = F.greatest(F.floor(sixth / residues), F.lit(1))
    width, rest = sixth / many, F.col("i") - 1 - F.floor((F.col("i") - 1) / sixth) * sixth
    own = F.greatest(F.least(F.floor(rest / width), many - 1), F.lit(0))
    low, high = F.when(rest - own * width < 2, F.pmod(own - 1, many)).otherwise(own), F.when((own + 1) * width - rest < 2, F.pmod(own + 1, many)).otherwise(own)
    return F.when(many > 1, F.array_distinct(F.array(own, low, high))).otherwise(F.array(F.lit(0).cast("long")))


def _mean_phases(rows: DataFrame, omega: float, residues: int) -> DataFrame:
    """rows (n, i, size, x, y, u, v) -> (n, c1_x, s1_x, ...): mean over at most seven lags, evenly spaced from 1 on, of the mean cosine and sine of the change over a lag, of scaled
    steps (1: u, v) and of omega times the positions (2: x, y). A row is sent to its block, seldom to two, whatever the number of lags."""
    names = ("c_x", "s_x", "k_x", "c_y", "s_y", "k_y")

    def run(batches):
        for t in whole_groups(batches, ("n", "g")):
            i, size, own = t.column("i").to_numpy().astype("int64"), t.column("size").to_numpy(), t.column("pos").to_numpy() == 0
            first = _starts(t, ("n", "g"))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
            key = group * (2 * int(size.max()) + 2) + i
            for kind, axes, last, scale in ((1, ("u", "v"), size - 2, 1.0), (2, ("x", "y"), size - 1, omega)):
                known = [t.column(a).is_valid().to_numpy() for a in axes]
                value = [t.column(a).to_numpy() for a in axes]
                there = known[0] if kind == 1 else np.ones(len(t), dtype=bool)
                m, before = np.minimum(last + 1, 7), np.zeros_like(last)
                for k in range(7):
                    lag = 1 + k * (last - 1) // np.maximum(m - 1, 1)
                    at = np.flatnonzero(own & there & (last > 0) & (k < m) & (lag != before))
                    before = lag
                    later = np.minimum(np.searchsorted(key, key[at] + lag[at]), len(key) - 1)
                    met = (key[later] == key[at] + lag[at]) & there[later]
                    at, later = at[met], later[met]
                    sums = []
                    for v, ok in zip(value, known, strict=True):
                        both = ok[at] & ok[later]
                        a, b = at[both], later[both]
                        with np.errstate(invalid="ignore"):
                            d = (v[b] - v[a]) * scale
                            sums += [np.bincount(group[a], w, len(first)) for w in (np.cos(d), np.sin(d))]
                        sums.append(np.bincount(group[a], minlength=len(first)))
                    some = np.flatnonzero(np.bincount(group[at], minlength=len(first)))
                    n = t.column("n").combine_chunks().take(pa.array(first[some]))
                    yield pa.RecordBatch.from_arrays([n, pa.array(np.full(len(some), kind, "int32")), pa.array(lag[first[some]])] + [pa.array(c[some].astype("float64")) for c in sums], names=["n", "kind", "lag", *names])

    dealt = rows.select("n", "i", "size", "x", "y", "u", "v", F.posexplode(_blocks(residues)).alias("pos", "g")).repartition("n", "g").sortWithinPartitions("n", "g", "i")
    sums = dealt.mapInArrow(run, f"n {dict(rows.dtypes)['n']}, kind int, lag long, " + ", ".join(f"{c} double" for c in names)).repartition("n")
    per = sums.groupBy("n", "kind", "lag").agg(*((F.sum(f"{p}_{a}") / F.nullif(F.sum(f"k_{a}"), F.lit(0.0))).alias(f"{p}_{a}") for a in "xy" for p in "cs"))
    return per.groupBy("n").agg(*(F.avg(F.when(F.col("kind") == kind, F.col(f"{p}_{a}"))).alias(f"{p}{kind}_{a}") for kind in (1, 2) for a in "xy" for p in "cs"))


def ergodicity_breaking(df: DataFrame, omega: float = 2.0, residues: int = RESIDUES) -> DataFrame:
    """(n, ergo_x, ergo_y, ergo2_x, ergo2_y): two estimators, near 0 for ergodic motion: of steps scaled by their root mean square, and of positions."""
    w, p, axes = along(), Window.partitionBy("n"), ("x", "y")
    rows = df.where("n is not null").select("n", "t", "row_id", *(F.col(a).cast("double").alias(a) for a in axes))
    rows = rows.withColumns({"i": F.row_number().over(w), **{f"d{a}": F.lead(a).over(w) - F.col(a) for a in axes}, **{f"{a}0": F.first(a).over(w) for a in axes}})
    rows = rows.withColumns({"size": F.count("*").over(p), **{f"r{a}": F.sqrt(F.avg(F.col(f"d{a}") * F.col(f"d{a}")).over(p)) for a in axes}}).where("size > 1")
    scaled = {s: F.when(F.col("dx").isNotNull(), F.col(f"d{a}") / F.when(F.col(f"r{a}") < 1e-8, 1.0).otherwise(F.col(f"r{a}"))) for s, a in zip("uv", axes, strict=True)}
    rows = rows.withColumns(scaled)
    square = lambda c: F.pow(F.avg(F.cos(c)), 2) + F.pow(F.avg(F.sin(c)), 2)
    own = rows.groupBy("n").agg(F.count("*").alias("size"), *(square(F.col(s)).alias(f"q1_{a}") for s, a in zip("uv", axes, strict=True)), *(square((F.col(a) - F.col(f"{a}0")) * omega).alias(f"q2_{a}") for a in axes))
    both = own.hint("merge").join(_mean_phases(rows, omega, residues), "n")
    shift = lambda a: 1 / F.col("size") - F.col(f"q2_{a}") / (F.col("size") * (F.col("size") + 1))
    one = (F.hypot(F.col(f"c1_{a}") - F.col(f"q1_{a}"), F.col(f"s1_{a}")).alias(f"ergo_{a}") for a in axes)
    return both.select("n", *(F.hypot(F.col(f"c2_{a}") + shift(a), F.col(f"s2_{a}")).alias(f"ergo2_{a}") for a in axes), *one)


def fractal_slope(df: DataFrame, centres: int = 30, radii: int = 20, largest: float = 0.5) -> DataFrame:
    """(n, frac_slope): a third of the difference of the fractal spectrum at 1.5 and at -1.5, each the intercept over radii of a logarithm of the mean
    power of the share of positions within a radius of a centre. The feature looks from at most `centres` positions, those of the least md5 of
    row_id; all positions count about each of them. Trajectories that never move have none."""
    places = df.select("n", "row_id", "x", "y").where("x is not null and y is not null")
    chosen = Window.partitionBy("n").orderBy(F.md5(F.col("row_id").cast("string")), "row_id")
    at = places.withColumn("q", F.row_number().over(chosen)).where(F.col("q") <= centres).select("n", "q", F.col("x").alias("qx"), F.col("y").alias("qy"))
    pairs = places.select("n", "x", "y").join(at, "n").select("n", "q", F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")).alias("d"))
    top = pairs.groupBy("n").agg(F.least(F.max("d"), F.lit(largest)).alias("top")).where("top > 0")
    r = lambda k: F.col("top") * float(4.0 ** (k / (radii - 1) - 1))
    within = pairs.join(top, "n").groupBy("n", "top", "q").agg(F.count("*").alias("size"), F.array(*(F.count(F.when(F.col("d") < r(k), 1)) for k in range(radii))).alias("near"))
    share = within.select("n", "top", "size", F.posexplode("near")).select("n", "pos", (F.col("col") / F.col("size")).alias("z"), (F.col("top") * F.pow(F.lit(4.0), F.col("pos") / (radii - 1) - 1)).alias("r"))
    d = {s: F.log("r") / (q - 1) * F.log(F.avg(F.pow("z", F.lit(q - 1)))) for s, q in (("low", -1.5), ("high", 1.5))}
    spectrum = share.groupBy("n", "pos", "r").agg(*(v.alias(s) for s, v in d.items())).where("r <> 1")
    return spectrum.groupBy("n").agg(((F.regr_intercept("high", "r") - F.regr_intercept("low", "r")) / 3).alias("frac_slope"))


def sliding(df: DataFrame, rows: int) -> DataFrame:
    """Mean and deviation of steps over windows of rows about each row; edges use the rows there are."""
    w = along().rowsBetween(-(rows // 2), (rows - 1) // 2)
    return _stepped(df).withColumns({"step_mean": F.avg("step").over(w), "step_std": F.stddev_pop("step").over(w)})


def row_windows(df: DataFrame, rows: int, step: int = 1) -> DataFrame:
    """Every window of `rows` successive rows of a trajectory, at starts 0, step, ... below its size less `rows`, as a trajectory of its own: n becomes `n:start`, so any
    feature applies to it. A row is copied into rows / step windows at most."""
    own = df.withColumns({"_i": F.row_number().over(along()) - 1, "_size": F.count("*").over(Window.partitionBy("n"))})
    first = F.greatest(F.ceil((F.col("_i") - (rows - 1)) / step), F.lit(0))
    last = F.floor(F.least(F.col("_i"), F.col("_size") - rows - 1) / step)
    dealt = own.where(first <= last).withColumn("_w", F.explode(F.sequence(first, last)))
    return dealt.withColumn("n", F.concat_ws(":", F.col("n").cast("string"), (F.col("_w") * step).cast("string"))).select(*df.columns)


def _by_window(df: DataFrame, feature: Callable[[DataFrame], DataFrame], rows: int, step: int) -> DataFrame:
    """The feature of every window: (n, start, ...)."""
    found = feature(row_windows(df, rows, step))
    start = F.substring_index("n", ":", -1).cast("int")
    n = F.expr("substring(n, 1, length(n) - length(substring_index(n, ':', -1)) - 1)").cast(df.schema["n"].dataType)
    return found.select(n.alias("n"), start.alias("start"), *(c for c in found.columns if c != "n"))


def feature_vector(df: DataFrame, feature: Callable[[DataFrame], DataFrame], rows: int, step: int = 1) -> DataFrame:
    """(n, i, ...): a feature (trajectories -> a row for each n) of windows of `rows` rows, at each window's middle row i = start + rows // 2; rows before the first middle take the first
    window's values, rows after the last one the last window's. Trajectories of at most `rows` rows have none."""
    size = df.groupBy("n").agg(F.count("*").cast("int").alias("_size"))
    found = _by_window(df, feature, rows, step).join(size, "n")
    end = ((F.col("_size") - rows - 1) / step).cast("int") * step
    low = F.when(F.col("start") == 0, 0).otherwise(F.col("start") + rows // 2)
    at = F.when((F.col("start") == 0) | (F.col("start") == end), F.sequence(low, F.when(F.col("start") == end, F.col("_size") - 1).otherwise(F.lit(rows // 2)))).otherwise(F.array(low))
    return found.withColumn("i", F.explode(at)).select("n", "i", *(c for c in found.columns if c not in ("n", "start", "_size")))


def mean_by_scale(df: DataFrame, feature: Callable[[DataFrame], DataFrame], scales: Sequence[int]) -> DataFrame:
    """(n, rows, ...): for each scale, the feature's mean over all windows of so many rows, over its value for the whole trajectory (null where that is 0)."""
    whole = feature(df)
    names = [c for c in whole.columns if c != "n"]
    whole = whole.select("n", *(F.col(c).alias(f"_{c}") for c in names))
    out = None
    for k in scales:
        one = _by_window(df, feature, k, 1).groupBy("n").agg(*(F.avg(c).alias(c) for c in names)).withColumn("rows", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.join(whole, "n").select("n", "rows", *((F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in names))


def resampled(df: DataFrame, points: int) -> DataFrame:
    """Trajectories at `points` evenly spaced times, linear between locations."""
    w = along()
    s = df.withColumns({"t1": F.lead("t").over(w), "x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "a": F.min("t").over(Window.partitionBy("n")), "b": F.max("t").over(Window.partitionBy("n"))}).where("t1 > t and b > a")
    s = s.withColumn("h", (F.col("b") - F.col("a")) / (points - 1))
    first, end = F.ceil((F.col("t") - F.col("a")) / F.col("h") - 1e-9), F.ceil((F.col("t1") - F.col("a")) / F.col("h") - 1e-9) - 1
    end = F.when(F.col("t1") == F.col("b"), F.lit(points - 1).cast("long")).otherwise(end)
    s = s.where(first <= end).withColumn("i", F.explode(F.sequence(first, end)))
    u = (F.col("a") + F.col("i") * F.col("h") - F.col("t")) / (F.col("t1") - F.col("t"))
    return s.select("n", F.col("i").cast("int").alias("i"), (F.col("a") + F.col("i") * F.col("h")).alias("t"), (F.col("x") + u * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + u * (F.col("y1") - F.col("y"))).alias("y"))


def spans(df: DataFrame) -> DataFrame:
    """Size, time range, and whether the time step is constant."""
    s = df.withColumn("_g", F.col("t") - F.lag("t").over(along()))
    return s.groupBy("n").agg(F.count("*").alias("size"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.avg("_g").alias("dt"), ((F.max("_g") - F.min("_g")) <= 1e-9).alias("is_dt_constant"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chains, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_measures(points: np.ndarray) -> tuple[float, float]:
    """(area, perimeter) of the convex hull."""
    h = _hull(points)
    if len(h) < 2:
        return 0.0, 0.0
    nxt = np.roll(h, -1, axis=0)
    return abs(float((h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1]).sum())) / 2, float(np.hypot(*(nxt - h).T).sum())


def hull_diameter(points: np.ndarray) -> float:
    """The largest distance between two positions, which are corners of the hull."""
    h = _hull(points)
    return max((float(np.hypot(*(h - q).T).max()) for q in h), default=0.0)


def _chains(group: np.ndarray, points: np.ndarray, rounds: int = 64) -> np.ndarray:
    """Where the corners of the chains below each group's points are: these are distinct, and sorted by group, x and y; reversed, those above. All groups lose the points that lie
    on or above the line between their neighbours in rounds, no two neighbours in one; what is not settled then is gone through in order."""
    at = np.arange(len(points))
    for _ in range(rounds):
        a, b, c = at[:-2], at[1:-1], at[2:]
        d, e = points[b] - points[a], points[c] - points[a]
        flat = np.flatnonzero((group[a] == group[c]) & (d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0] <= 0))
        if not len(flat):
            return at
        k = np.arange(len(flat))
        run = np.maximum.accumulate(np.where(np.diff(flat, prepend=-2) > 1, k, 0))
        at = np.delete(at, flat[(k - run) % 2 == 0] + 1)
    open_, out = set(group[b[flat]].tolist()), []
    for q in at.tolist():
        g, (x, y) = group[q], points[q]
        while g in open_ and len(out) > 1 and group[out[-2]] == g and (points[out[-1]][0] - points[out[-2]][0]) * (y - points[out[-2]][1]) - (points[out[-1]][1] - points[out[-2]][1]) * (x - points[out[-2]][0]) <= 0:
            out.pop()
        out.append(q)
    return np.array(out, dtype=at.dtype)


def _hulls(group: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Where the corners of each group's hull are, group by group, counter-clockwise: _hull() of all groups at once."""
    order = np.lexsort((points[:, 1], points[:, 0], group))
    g, p = group[order], points[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1]).any(1)])[: len(g)]
    order, g, p = order[new], g[new], p[new]
    first = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
    last = np.concatenate([g[1:] != g[:-1], [True]])[: len(g)]
    low, high = _chains(g, p), len(g) - 1 - _chains(g[::-1], p[::-1])
    corners = np.concatenate([low[~last[low] | first[low]], high[~first[high]]])  # a lone point is its hull
    return order[corners[np.argsort(g[corners], kind="stable")]]


def hull_corners(df: DataFrame, key: str) -> DataFrame:
    """(key, x, y): few rows of each group, among them all corners of its hull. Each batch keeps the corners of its own rows, before any shuffle, so no task holds
    a whole group; hulls of hulls are exact."""

    def reduce(batches):
        for b in batches:
            x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            code = b.column(0).dictionary_encode().indices.to_numpy()
            yield b.take(pa.array(_hulls(code, np.stack([x, y], 1))))

    rows = df.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    return rows.mapInArrow(reduce, f"{key} {dict(df.dtypes)[key]}, x double, y double")


def _measured(group: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Area, perimeter and diameter of hulls, whose corners are given group by group, counter-clockwise."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, len(p)))
    owner, start = np.repeat(np.arange(len(first)), size), np.repeat(first, size)
    place, many = np.arange(len(p)) - start, np.repeat(size, size)
    nxt = p[start + (place + 1) % many]
    area = np.abs(np.add.reduceat(p[:, 0] * nxt[:, 1] - nxt[:, 0] * p[:, 1], first)) / 2
    perimeter, widest = np.add.reduceat(np.hypot(*(nxt - p).T), first), np.zeros(len(first))
    rest = np.arange(len(p))
    for k in range(1, int(size.max()) // 2 + 1):
        rest = rest[many[rest] >= 2 * k]
        d = np.hypot(*(p[start[rest] + (place[rest] + k) % many[rest]] - p[rest]).T)
        begin = np.flatnonzero(np.diff(owner[rest], prepend=-1))
        held = owner[rest[begin]]
        widest[held] = np.maximum(widest[held], np.maximum.reduceat(d, begin))
    return area, perimeter, widest


def convex_hull(df: DataFrame, key: str = "n") -> DataFrame:
    """Area, perimeter and diameter of the hull of each group's positions, from the corners of hulls of slices; many groups at a time."""

    def measure(batches):
        for t in whole_groups(batches, (key,)):
            points = np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], 1)
            first = _starts(t, (key,))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
            at = _hulls(group, points)
            names = t.column(key).combine_chunks().take(pa.array(first))
            yield pa.RecordBatch.from_arrays([names, *map(pa.array, _measured(group[at], points[at]))], names=[key, "hull_area", "hull_perimeter", "hull_diameter"])

    kind = dict(df.dtypes)[key]
    return hull_corners(df, key).repartition(key).sortWithinPartitions(key).mapInArrow(measure, f"{key} {kind}, hull_area double, hull_perimeter double, hull_diameter double")


def shape_features(df: DataFrame) -> DataFrame:
    """The features of a trajectory's shape: hull, gyration and its asymmetries, efficiency, straightness and kurtosis along the main axis."""
    out = gyration(df)
    for part in (efficiency(df), axis_kurtosis(df), convex_hull(df)):
        out = out.join(part.select("n", *(c for c in part.columns if c not in out.columns)), "n", "left")
    return out


def all_features(df: DataFrame, lags: Sequence[int] = LAGS, largest: float = 0.5) -> DataFrame:
    """Every feature, joined on n. Each part is written, a row a trajectory, before they are joined, so no task sorts rows for several parts at once. `largest` bounds
    the radii of the fractal slope."""
    out = stored(spans(df))
    for part in (step_moments(df), msd_fit(df, lags), drift(df), displacement_pdf_fit(df, lags), gyration(df), efficiency(df), axis_kurtosis(df), angle_features(df), step_autocorrelation(df), gaussianity_features(df, lags), ergodicity(df), escape_distances(df), convex_hull(df), ergodicity_breaking(df), fractal_slope(df, largest=largest)):
        out = out.join(stored(part.select("n", *(c for c in part.columns if c not in out.columns))).hint("merge"), "n", "left")
    return out


def _farthest_later(p: np.ndarray, block: int = 256) -> np.ndarray:
    """For each position the distance of the farthest later one: pairs within a block, and the corners of the hull of all later blocks."""
    out, hull = np.zeros(len(p)), np.zeros((0, 2))
    for end in range(len(p), 0, -block):
        start = max(0, end - block)
        own = p[start:end]
        d = np.hypot(own[:, None, 0] - own[None, :, 0], own[:, None, 1] - own[None, :, 1])
        out[start:end] = np.triu(d).max(1)
        if len(hull):
            out[start:end] = np.maximum(out[start:end], np.hypot(own[:, None, 0] - hull[None, :, 0], own[:, None, 1] - hull[None, :, 1]).max(1))
        hull = _hull(np.concatenate([own, hull]))
    return out


def escape_distances(df: DataFrame) -> DataFrame:
    """Distances that a quarter, a half and three quarters of a trajectory's positions are left behind by: quantiles of the farthest later
    distance from each position. A trajectory's positions meet in one task, as three numbers each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("row_id", "ascending")])
        far = _farthest_later(np.stack([table.column("x").to_numpy(), table.column("y").to_numpy()], 1))
        return pa.table({"n": table.column("n").slice(0, 1), **{f"escape_{k}": [float(np.quantile(far, 1 - q))] for q, k in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))}})

    rows = df.select("n", "t", "row_id", F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null")
    return rows.groupBy("n").applyInArrow(run, f"n {dict(df.dtypes)['n']}, escape_q1 double, escape_median double, escape_q3 double")


def per_duration(features: DataFrame, names: Sequence[str], root: bool = False) -> DataFrame:
    """Features divided by the duration, or its root."""
    d = F.col("t_max") - F.col("t_min")
    return features.withColumns({c: F.col(c) / (F.sqrt(d) if root else d) for c in names})
