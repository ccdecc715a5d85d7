"""Steps and the cells they belong to: by both ends, or shared among all cells that a step's line crosses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.operators.assign import nearest
from stepfield.sources.storage import stored


def both_ends(steps: DataFrame, start: str = "cell", stop: str = "cell_to") -> DataFrame:
    """steps with `member`: a row for the cell of the start, and one more for that of the end if it is another. Ends without a cell count nowhere."""
    ends = F.array_distinct(F.filter(F.array(start, stop), lambda c: c.isNotNull()))
    return steps.withColumn("member", F.explode(ends))


def crossed_cells(steps: DataFrame, cells: DataFrame, rounds: int = 64) -> DataFrame:
    """steps (row_id, x, y, dx, dy) and centres (cell, c_x, c_y) -> (row_id, cell, share): for every cell whose Voronoi region the step's line crosses,
    the share of its length that lies there; a step's shares sum to 1. A step without length lies in its cell, one of a null coordinate nowhere.

    A piece of the line between two different cells is cut where both centres are equally far. If no centre is nearer to that place,
    it is the border between them; else the nearest centre's cell is crossed too and the piece becomes two. All pieces of all steps
    are judged in a round, so a step across k cells takes log2(k) to k rounds of nearest joins over the open pieces alone."""
    whole = steps.where("x is not null and y is not null and dx is not null and dy is not null").select("row_id", "x", "y", "dx", "dy")
    at = lambda k: cells.select(F.col("cell").alias(k), F.col("c_x").alias(f"{k}x"), F.col("c_y").alias(f"{k}y"))
    first = nearest(whole, cells).withColumnsRenamed({"cell": "i"}).drop("distance")
    moved = first.select("row_id", "i", F.col("x").alias("x0"), F.col("y").alias("y0"), "dx", "dy", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    both = nearest(moved, cells).select("row_id", F.col("x0").alias("px"), F.col("y0").alias("py"), "dx", "dy", F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), "i", F.col("cell").alias("j"))
    open_, out = stored(both), None
    for _ in range(rounds):
        same = open_.where("i = j").select("row_id", F.col("i").alias("cell"), (F.col("t1") - F.col("t0")).alias("share"))
        out = same if out is None else out.unionByName(same)
        cut = open_.where("i <> j").join(at("i"), "i").join(at("j"), "j")
        ux, uy = F.col("ix") - F.col("jx"), F.col("iy") - F.col("jy")
        t = F.try_divide(((F.col("ix") + F.col("jx")) / 2 - F.col("px")) * ux + ((F.col("iy") + F.col("jy")) / 2 - F.col("py")) * uy, F.col("dx") * ux + F.col("dy") * uy)
        cut = cut.withColumn("t", F.least(F.greatest(F.coalesce(t, F.col("t0")), "t0"), "t1"))
        cut = cut.withColumns({"x": F.col("px") + F.col("t") * F.col("dx"), "y": F.col("py") + F.col("t") * F.col("dy")})
        cut = stored(nearest(cut, cells).withColumnRenamed("cell", "k"))
        own = F.hypot(F.col("x") - F.col("ix"), F.col("y") - F.col("iy"))
        more = (F.col("k") != F.col("i")) & (F.col("k") != F.col("j")) & (F.col("distance") < own * (1 - 1e-9))
        border = cut.where(~more)
        for c, a, b in (("i", "t0", "t"), ("j", "t", "t1")):
            out = out.unionByName(border.select("row_id", F.col(c).alias("cell"), (F.col(b) - F.col(a)).alias("share")))
        base, split = ("row_id", "px", "py", "dx", "dy"), cut.where(more)
        open_ = stored(split.select(*base, "t0", F.col("t").alias("t1"), "i", F.col("k").alias("j")).unionByName(split.select(*base, F.col("t").alias("t0"), "t1", F.col("k").alias("i"), "j")))
        if open_.isEmpty():
            return out.groupBy("row_id", "cell").agg(F.sum("share").alias("share")).where("share > 0")
    raise RuntimeError(f"steps not shared out after {rounds} rounds")
