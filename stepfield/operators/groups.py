"""Groups of near cells with a margin, for maps that are solved part by part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.operators.infer import SIGMA2, smooth_joined
from stepfield.operators.trajectory import offsets
from stepfield.sources.storage import stored

BITS = 16


def _spread(v: Column) -> Column:
    """The lowest 16 bits of a number, each followed by a free one."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def along_curve(cells: DataFrame) -> DataFrame:
    """cells (cell, c_x, c_y) with `code`, the place of the centre on a Z-order curve of 2^16 steps a side through their bounding square. Cells without a
    centre have no row."""
    cells = cells.where("c_x IS NOT NULL AND c_y IS NOT NULL")
    x0, x1, y0, y1 = cells.agg(F.min("c_x"), F.max("c_x"), F.min("c_y"), F.max("c_y")).first()
    side = max(x1 - x0, y1 - y0) if x0 is not None else 0.0
    steps = lambda c, low: F.least(F.floor((F.col(c) - (low or 0.0)) / (side or 1.0) * float(1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
    return cells.withColumn("code", _spread(steps("c_x", x0)).bitwiseOR(F.shiftleft(_spread(steps("c_y", y0)), 1)))


def groups(cells: DataFrame, edges: DataFrame, size: int, margin: int = 2) -> DataFrame:
    """cells (cell, c_x, c_y), edges (i, j) -> (part, cell, distance): parts of `size` cells (the last may have fewer) that follow each other on a Z-order curve, at
    distance 0, and the cells that edges reach from them within `margin` steps, at the number of steps. A cell is at distance 0 in one
    part, and in the margin of as many as are near. Cells of one code follow by number. The curve's codes are counted by ranges; a round of the
    margin is one join."""
    coded = stored(along_curve(cells).select("cell", "code"), "coded")
    base = offsets(coded.groupBy("code").agg(F.count("*").alias("k")), "code", "k").select("code", "base")
    nth = F.row_number().over(Window.partitionBy("code").orderBy("cell")) - 1
    seen = front = stored(coded.withColumn("nth", nth).join(base, "code").select(F.floor((F.col("base") + F.col("nth")) / size).alias("part"), "cell", F.lit(0).alias("distance")), "parts")
    links = stored(edges.select("i", "j").distinct(), "links")
    for step in range(1, margin + 1):
        near = front.join(links, F.col("cell") == F.col("i")).select("part", F.col("j").alias("cell")).distinct()
        front = stored(near.join(coded.select("cell"), "cell", "left_semi").join(seen.select("part", "cell"), ["part", "cell"], "left_anti").select("part", "cell", F.lit(step).alias("distance")), "parts")
        seen = seen.unionByName(front)
    return seen


def smooth_by_groups(cells: DataFrame, edges: DataFrame, prior: float, size: int, margin: int = 2, mode: str = "d", sigma2: float = SIGMA2, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """smooth_joined() of every part with its margin by itself, all at once, of which the parts' own cells are kept: cells are those of
    statistics() with c_x and c_y, numbered from 0. What a margin leaves out weighs less with every step, so a wider one comes nearer to the whole map."""
    parts = stored(groups(cells, edges, size, margin), "groups")
    key = lambda c: (F.col("part") * (1 << 31) + F.col(c)).alias(c)
    copies = cells.join(parts, "cell").select(key("cell"), *(c for c in cells.columns if c not in ("cell", "part", "distance")))
    ends = [parts.select("part", F.col("cell").alias(c)) for c in ("i", "j")]
    inside = edges.select("i", "j").distinct().join(ends[0], "i").join(ends[1], ["part", "j"]).select(key("i"), key("j"))
    solved = smooth_joined(copies, inside, prior, mode, sigma2, rounds, tolerance)
    own = parts.where("distance = 0").select(F.col("cell").alias("_cell"), key("cell"))
    return solved.join(own, "cell").drop("cell").withColumnRenamed("_cell", "cell").select("cell", *(c for c in solved.columns if c != "cell"))
