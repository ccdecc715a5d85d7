"""Which neighbouring cells hold points that run into each other: Welch's test on the points nearest to the common side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a cell that are tested, and intervals of the quadrature.
POINTS, INTERVALS = 10, 100
ALPHA = 1e-15


def _sine_integral(power: Column, upper: Column, intervals: int) -> Column:
    """Integral of sin^power from 0 to upper, by Simpson's rule in the square root of the angle, which smooths the start. It starts where the integrand
    is below e^-40 of its end, so that high powers keep their nodes where they count."""
    start = F.sqrt(F.greatest(F.lit(0.0), upper - F.sqrt(80 / F.greatest(power, F.lit(1e-3)))))
    h = (F.sqrt(upper) - start) / intervals
    weight = lambda k: F.when((k == 0) | (k == intervals), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    at = lambda k: start + k * h
    term = lambda k: weight(k) * 2 * at(k) * F.pow(F.sin(at(k) * at(k)), power)
    return F.aggregate(F.sequence(F.lit(0), F.lit(intervals)), F.lit(0.0), lambda acc, k: acc + term(k)) * h / 3


def student_p(t: Column, freedom: Column, intervals: int = INTERVALS) -> Column:
    """Two-sided tail probability of Student's distribution, of one degree of freedom or more: with t = sqrt(freedom) / tan(angle), its density is sin^(freedom - 1)."""
    angle = F.atan2(F.sqrt(freedom), F.abs(t))
    return _sine_integral(freedom - 1, angle, intervals) / _sine_integral(freedom - 1, F.lit(3.141592653589793 / 2), intervals)


def tested_edges(assigned: DataFrame, edges: DataFrame, alpha: float = ALPHA, points: int = POINTS) -> DataFrame:
    """assigned (cell, row_id, x, y) and edges (i, j) -> (i, j, n_i, n_j, t, freedom, p, valid), a row per edge with i < j whose cells hold two points or more.

    Points are projected on the line between the two cells' mean points; of either cell the `points` ones farthest towards the other are compared by Welch's test,
    and the edge is valid if p exceeds alpha. Cells of no spread at all differ (p 0) unless they are at one place (p 1). Edges given in both
    directions or twice count once; null coordinates don't count. A point meets the edges of its cell only, and the ranks are cut before the shuffle, so no cell meets
    in one task."""
    here = assigned.select("cell", "row_id", "x", "y").dropna()
    means = here.groupBy("cell").agg(F.avg("x").alias("m_x"), F.avg("y").alias("m_y"), F.count("*").alias("k")).where("k > 1")
    pairs = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i < j").distinct()
    side = lambda c: means.select(F.col("cell").alias(c), F.col("m_x").alias(f"x_{c}"), F.col("m_y").alias(f"y_{c}"))
    lines = pairs.join(side("i"), "i").join(side("j"), "j").select("i", "j", "x_i", "y_i", (F.col("x_j") - F.col("x_i")).alias("u"), (F.col("y_j") - F.col("y_i")).alias("w"))
    both = lines.select("*", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("i").alias("cell")), F.struct(F.lit(-1).alias("sign"), F.col("j").alias("cell")))).alias("o")).select("i", "j", "x_i", "y_i", "u", "w", "o.sign", "o.cell")
    on = here.join(both, "cell").withColumn("v", (F.col("x") - F.col("x_i")) * F.col("u") + (F.col("y") - F.col("y_i")) * F.col("w"))
    nth = F.row_number().over(Window.partitionBy("i", "j", "sign").orderBy((F.col("v") * F.col("sign")).desc(), "row_id"))
    near = on.withColumn("nth", nth).where(F.col("nth") <= points)
    part = lambda f, s: f(F.when(F.col("sign") == s, F.col("v")))
    sums = near.groupBy("i", "j").agg(*(part(f, s).alias(f"{a}_{c}") for c, s in (("i", 1), ("j", -1)) for a, f in (("n", F.count), ("a", F.avg), ("s", F.var_samp))))
    e_i, e_j = F.col("s_i") / F.col("n_i"), F.col("s_j") / F.col("n_j")
    apart, spread = F.col("a_i") - F.col("a_j"), e_i + e_j
    out = sums.withColumns({"t": F.try_divide(apart, F.sqrt(spread)), "freedom": F.try_divide(spread * spread, e_i * e_i / (F.col("n_i") - 1) + e_j * e_j / (F.col("n_j") - 1))})
    p = F.when(spread > 0, student_p(F.col("t"), F.col("freedom"))).when(apart == 0, 1.0).otherwise(0.0)
    return out.withColumn("p", p).select("i", "j", "n_i", "n_j", "t", "freedom", "p", (F.col("p") > alpha).alias("valid"))
