"""Operators on ordered trajectories. Windows run within a trajectory; nothing is sorted over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.functions.columns import COORDS, along, euclidean, in_box, squared
from stepfield.sources.storage import checkpointed


def displacements(df: DataFrame, coords: Sequence[str] = COORDS) -> DataFrame:
    """Rows of displacements from the row before, named d*, without the first row of a trajectory."""
    w = along()
    return df.select("n", "row_id", *((F.col(c) - F.lag(c).over(w)).alias(f"d{c}") for c in coords)).dropna()


def to_translocations(df: DataFrame, coords: Sequence[str] = COORDS) -> DataFrame:
    """Adds d* of the coordinates and of t to the row that a step starts from; rows without a next one, or with missing values, go."""
    w = along()
    steps = {f"d{c}": F.lead(c).over(w) - F.col(c) for c in (*coords, "t")}
    return df.withColumns(steps).dropna(subset=[*coords, "t", *steps])


def to_trajectories(df: DataFrame, coords: Sequence[str] = COORDS) -> DataFrame:
    """The inverse: the origins, and the end of each trajectory's last step; its row_id is the last one's, negated less one."""
    every = (*coords, "t")
    late = Window.partitionBy("n").orderBy(F.col("t").desc(), F.col("row_id").desc())
    last = df.withColumn("_r", F.row_number().over(late)).where("_r = 1")
    ends = last.select("n", (-F.col("row_id") - 1).alias("row_id"), *((F.col(c) + F.col(f"d{c}")).alias(c) for c in every))
    return df.select("n", "row_id", *every).unionByName(ends)


def repaired_steps(df: DataFrame, coords: Sequence[str] = COORDS) -> DataFrame:
    """Steps of negative duration turned round."""
    back = F.col("dt") < 0
    return df.withColumns({f"d{c}": F.when(back, -F.col(f"d{c}")).otherwise(F.col(f"d{c}")) for c in (*coords, "t")})


def offsets(counts: DataFrame, key: str, count: str, buckets: int = 64) -> DataFrame:
    """counts (key integer, count) with base: the sum of the counts of all smaller keys. Rows are cut into ranges of about equal numbers of rows,
    however keys cluster; only the ranges' sums pass through the driver."""
    ranged = checkpointed(counts.repartitionByRange(buckets, key).withColumn("_b", F.spark_partition_id()))
    sums = {r._b: r.s for r in ranged.groupBy("_b").agg(F.sum(count).alias("s")).collect()}
    if not sums:
        return counts.withColumn("base", F.lit(0).cast("long"))
    before, total = {}, 0
    for b in sorted(sums):
        before[b], total = total, total + (sums[b] or 0)
    start = F.create_map(*(x for b, v in before.items() for x in (F.lit(b), F.lit(v).cast("long"))))
    w = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("base", F.element_at(start, F.col("_b")) + F.coalesce(F.sum(count).over(w), F.lit(0))).drop("_b")


def compact_ids(df: DataFrame, part: str) -> DataFrame:
    """n replaced by numbers from 1 that follow the order of (n, part); `part` numbers the pieces of a trajectory in any increasing way."""
    ranked = df.withColumn("_k", F.dense_rank().over(Window.partitionBy("n").orderBy(part)).cast("long"))
    base = offsets(ranked.groupBy("n").agg(F.max("_k").alias("_c")), "n", "_c")
    return ranked.join(base.select("n", "base"), "n").withColumn("n", F.col("base") + F.col("_k")).drop("_k", "base", part)


def crop(df: DataFrame, lower: dict[str, float], upper: dict[str, float], by: str | None = None, coords: Sequence[str] = COORDS, deltas: bool = True) -> DataFrame:
    """Rows in a closed box, with steps taken before the cut, split where a trajectory leaves it; `seg` counts a trajectory's rows
    outside so far, so (n, seg) names a piece. Pieces of one row go. by='start' also keeps the end of a step that starts
    inside, by='stop' the start of one that ends inside."""
    w = along()
    inside = in_box(lower, upper)
    marked = df.withColumn("_in", inside)
    if by == "start":
        marked = marked.withColumn("_in", F.col("_in") | F.coalesce(F.lag("_in").over(w), F.lit(False)))
    elif by == "stop":
        marked = marked.withColumn("_in", F.col("_in") | F.coalesce(F.lead("_in").over(w), F.lit(False)))
    steps = {f"d{c}": F.lead(c).over(w) - F.col(c) for c in (*coords, "t")} if deltas else {}
    marked = marked.withColumns(steps | {"seg": F.sum((~F.col("_in")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return marked.where("_in").withColumn("_c", F.count("*").over(Window.partitionBy("n", "seg"))).where("_c > 1").drop("_c", "_in")


def first_step(df: DataFrame) -> float | None:
    """The least time step of the first trajectory that has one."""
    gaps = df.withColumn("_g", F.col("t") - F.lag("t").over(along())).where("_g is not null").groupBy("n").agg(F.min("_g").alias("g"))
    return gaps.agg(F.min_by("g", "n")).first()[0]


def split_at_gaps(df: DataFrame, dt: float | None = None) -> DataFrame:
    """`seg`: a trajectory's number of gaps so far; a gap is a jump of the frame number rint(t / dt) by more than one."""
    dt = first_step(df) if dt is None else dt
    w = along()
    frame = F.rint(F.col("t") / dt)
    gap = F.coalesce((frame - F.lag(frame).over(w)) > 1, F.lit(False)).cast("long")
    return df.withColumn("_g", gap).withColumn("seg", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_g")


def reindex(df: DataFrame, dt: float | None = None) -> DataFrame:
    """Trajectories split at gaps and numbered from 1."""
    return compact_ids(split_at_gaps(df, dt), "seg")


def _static(coords: Sequence[str], min_msd: float) -> Column:
    return (squared([f"d{c}" for c in coords]) / len(coords)) < min_msd


def drop_static_steps(df: DataFrame, min_msd: float, coords: Sequence[str] = COORDS) -> DataFrame:
    """Without the ends of static steps (mean square over dimensions below min_msd), and then without single rows."""
    w = along()
    moved = df.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in coords}).where(~F.coalesce(_static(coords, min_msd), F.lit(False)))
    return drop_singletons(moved.drop(*(f"d{c}" for c in coords)))


def drop_static_trajectories(df: DataFrame, min_msd: float, ratio: float | None = None, coords: Sequence[str] = COORDS) -> DataFrame:
    """Without trajectories that have a static step, or a share of static steps of at least `ratio`."""
    w = along()
    share = F.avg(_static(coords, min_msd).cast("double")).over(Window.partitionBy("n"))
    marked = df.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in coords}).withColumn("_s", share)
    kept = F.coalesce(F.col("_s"), F.lit(0.0)) < ratio if ratio is not None else F.coalesce(F.col("_s"), F.lit(0.0)) == 0
    return marked.where(kept).drop("_s", *(f"d{c}" for c in coords))


def drop_singletons(df: DataFrame) -> DataFrame:
    return df.withColumn("_c", F.count("*").over(Window.partitionBy("n"))).where("_c > 1").drop("_c")


def full_trajectories(cropped: DataFrame, full: DataFrame, coords: Sequence[str] = COORDS) -> DataFrame:
    """The whole trajectories of `full` whose location is the first one of a cropped trajectory."""
    first = cropped.withColumn("_r", F.row_number().over(along())).where("_r = 1").select(*coords, "t")
    return full.join(full.join(first, [*coords, "t"], "left_semi").select("n").distinct(), "n", "left_semi")


def join_by_values(sample: DataFrame, full: DataFrame, on: Sequence[str] = ("x", "y", "t")) -> DataFrame:
    """Left join on exact values; raises if a sampled location is not unique in `full`."""
    if full.join(sample.select(*on).distinct(), list(on), "left_semi").groupBy(*on).count().where("count > 1").limit(1).collect():
        raise ValueError("locations are not unique")
    return sample.join(full, list(on), "left")


def frames(df: DataFrame, dt: float, t0: float | None = None) -> DataFrame:
    """`frame`: the nearest multiple of dt behind t0 (the table's first time)."""
    t0 = df.agg(F.min("t")).first()[0] if t0 is None else t0
    return df.withColumn("frame", F.rint((F.col("t") - F.lit(t0)) / dt).cast("long"))


def frame_counts(framed: DataFrame) -> DataFrame:
    """Locations in every frame from the first to the last, empty ones included."""
    low, high = framed.agg(F.min("frame"), F.max("frame")).first()
    spine = framed.sparkSession.range(low or 0, (high or 0) + 1 if high is not None else 0).withColumnRenamed("id", "frame")
    return spine.join(framed.groupBy("frame").agg(F.count("*").alias("k")), "frame", "left").fillna(0, ["k"])


def mean_step(df: DataFrame, coords: Sequence[str] = COORDS) -> DataFrame:
    """One row: steps and their mean length."""
    return displacements(df, coords).agg(F.count("*").alias("steps"), F.avg(euclidean([f"d{c}" for c in coords])).alias("mean_step"))


def useful(df: DataFrame, least: int, bound: float) -> DataFrame:
    """Trajectories with more than `least` distinct x and no position as far from the origin as `bound`."""
    kept = df.groupBy("n").agg(F.count_distinct("x").alias("k"), F.max(F.hypot("x", "y")).alias("far")).where((F.col("k") > least) & (F.col("far") < bound))
    return df.join(kept.select("n"), "n", "left_semi")


def ordered_by_start(df: DataFrame) -> DataFrame:
    """`start`: the first time of the row's trajectory, to order or group trajectories by."""
    return df.withColumn("start", F.min("t").over(Window.partitionBy("n")))
