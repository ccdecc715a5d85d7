"""Closed rings of cells at any distance from a cell, exterior cells, and the contour round the interior ones.

Frontiers are one table keyed by the cell in their middle, widened a step at a time for all cells at once. Rings and contours are put in order
by pointer jumping: every node doubles its jump in a round, so a cycle of n nodes takes about 2 log2(n) joins, and no cycle is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfield.sources.storage import stored

ROUNDS = 64


def frontiers(edges: DataFrame, distance: int) -> DataFrame:
    """(centre, cell, distance): the cells at each number of steps up to `distance` from every cell that has an edge."""
    e = edges.select("i", "j").where("i <> j").distinct()
    front = e.select(F.col("i").alias("centre"), F.col("i").alias("cell")).distinct()
    before, out = front, front.withColumn("distance", F.lit(0))
    for d in range(1, distance + 1):
        met = front.join(e, F.col("cell") == F.col("i")).select("centre", F.col("j").alias("cell")).distinct()
        new = stored(met.join(front, ["centre", "cell"], "left_anti").join(before, ["centre", "cell"], "left_anti"))
        before, front, out = front, new, out.unionByName(new.withColumn("distance", F.lit(d)))
    return out


def ranked_cycles(successors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(key, node, next), next being a permutation of each key's nodes -> (key, loop, node, position, size): the least node of the node's
    cycle, the steps from that node to this one, and the cycle's length."""
    nodes = stored(successors.select("key", "node", "next"))
    at = nodes.select("key", "node", F.col("next").alias("jump"), F.col("node").alias("low"))
    to = lambda t, *c: t.select("key", F.col("node").alias("jump"), *c)
    for _ in range(rounds):
        there = to(at, F.col("jump").alias("then"), F.col("low").alias("low_there"))
        at = stored(at.join(there, ["key", "jump"]).select("key", "node", F.col("then").alias("jump"), F.least("low", "low_there").alias("low"), (F.col("low_there") < F.col("low")).alias("fell")))
        fell = at.where("fell").isEmpty()
        at = at.drop("fell")
        if fell:  # windows of one size hold the same least node as those of twice that size, so as the whole cycle
            break
    else:
        raise RuntimeError(f"cycles not found after {rounds} rounds")
    first = F.col("node") == F.col("low")
    at = nodes.join(at.select("key", "node", "low"), ["key", "node"])
    at = at.select("key", "node", "low", F.when(first, F.col("node")).otherwise(F.col("next")).alias("jump"), F.when(first, 0).otherwise(1).cast("long").alias("steps"))
    for _ in range(rounds):
        if at.where("jump <> low").isEmpty():
            break
        there = to(at, F.col("jump").alias("then"), F.col("steps").alias("more"))
        at = stored(at.join(there, ["key", "jump"]).select("key", "node", "low", F.col("then").alias("jump"), (F.col("steps") + F.col("more")).alias("steps")))
    else:
        raise RuntimeError(f"cycles not ranked after {rounds} rounds")
    size = at.groupBy("key", "low").agg(F.count("*").alias("size"))
    return at.join(size, ["key", "low"]).select("key", F.col("low").alias("loop"), "node", ((F.col("size") - F.col("steps")) % F.col("size")).alias("position"), "size")


def contours(edges: DataFrame, distance: int = 1, closing: DataFrame | None = None) -> DataFrame:
    """(centre, cell, position, size): the cells at `distance` steps from each cell, where they form one closed ring, in the ring's order from the least
    cell to the smaller of its neighbours. Neighbours within a ring are those of `closing`, if given: on a grid, distances may go by eight
    neighbours and rings close by four. A cell whose frontier is open, branched, in pieces or of fewer than three cells has none."""
    front = stored(frontiers(edges, distance).where(F.col("distance") == distance).select("centre", "cell"))
    e = (edges if closing is None else closing).select("i", "j").where("i <> j").distinct()
    arcs = front.join(e, F.col("cell") == F.col("i")).select("centre", "i", "j").join(front.select("centre", F.col("cell").alias("j")), ["centre", "j"], "left_semi")
    degree = arcs.groupBy("centre", "i").agg(F.count("*").alias("n"), F.sum("j").alias("both"))
    sizes = front.groupBy("centre").agg(F.count("*").alias("cells"))
    whole = degree.groupBy("centre").agg(F.count("*").alias("met"), F.min("n").alias("a"), F.max("n").alias("b")).join(sizes, "centre").where("met = cells and a = 2 and b = 2 and cells > 2")
    turn = arcs.join(whole.select("centre"), "centre", "left_semi").join(degree.select("centre", F.col("i").alias("j"), "both"), ["centre", "j"])
    # behind the arc from i to j comes the one from j to its other neighbour, so each ring is walked both ways
    ranked = ranked_cycles(turn.select(F.col("centre").alias("key"), F.struct("i", "j").alias("node"), F.struct(F.col("j").alias("i"), (F.col("both") - F.col("i")).cast(edges.schema["i"].dataType).alias("j")).alias("next")))
    way = ranked.groupBy("key").agg(F.min("loop").alias("loop"))
    out = ranked.join(way, ["key", "loop"]).join(sizes.withColumnRenamed("centre", "key"), "key").where("size = cells")
    return out.select(F.col("key").alias("centre"), F.col("node.i").alias("cell"), "position", "size")


def exterior_cells(polygons: DataFrame) -> DataFrame:
    """(cell) of voronoi.polygons() that the box bounds: give it the data's bounds with a margin."""
    return polygons.where(F.exists("side", lambda s: s < 0)).select("cell")


def _sides(polygons: DataFrame) -> DataFrame:
    """(cell, beyond, x, y, after): a row per side that both cells know, where it starts, and the cell beyond the next side counter-clockwise."""
    k = F.posexplode("side").alias("k", "beyond")
    end = F.expr("(k + 1) % size(v_x)")
    rows = polygons.select("cell", "v_x", "v_y", k)
    rows = rows.select("cell", "k", "beyond", F.get("v_x", "k").alias("x"), F.get("v_y", "k").alias("y"), F.hypot(F.get("v_x", end) - F.get("v_x", "k"), F.get("v_y", end) - F.get("v_y", "k")).alias("length")).where("length > 1e-9")
    both = rows.join(rows.select(F.col("cell").alias("beyond"), F.col("beyond").alias("cell")).distinct(), ["cell", "beyond"], "left_semi")
    rows = both.unionByName(rows.where("beyond < 0"))
    w = Window.partitionBy("cell").orderBy("k")
    first = F.first("beyond").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("cell", "beyond", "x", "y", F.coalesce(F.lead("beyond").over(w), first).alias("after"))


def interior_contour(polygons: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(loop, position, x, y, cell, beyond): the closed lines between the interior cells and the exterior ones, corner by corner, with the interior
    on the left; cell and beyond lie along the side that starts there. loop is a number of the line, its least cell's; a line round a hole is one more.

    Behind a side of the contour comes the cell's next side, if an exterior cell lies beyond it; else the corner is turned through the cells
    about it, all corners a cell in a round."""
    sides = stored(_sides(polygons))
    outer = exterior_cells(polygons)
    inner = sides.join(outer, "cell", "left_anti")
    edge = stored(inner.join(outer.select(F.col("cell").alias("beyond")), "beyond", "left_semi").select("cell", "beyond", "x", "y", "after"))
    on = edge.select("cell", "beyond")
    turning, found = edge.select(F.struct("cell", "beyond").alias("node"), "cell", F.col("after").alias("beyond")), None
    for _ in range(rounds):
        met = turning.join(on, ["cell", "beyond"], "left_semi").select("node", F.struct("cell", "beyond").alias("next"))
        found = met if found is None else found.unionByName(met)
        rest = turning.join(on, ["cell", "beyond"], "left_anti")
        turned = rest.select("node", F.col("beyond").alias("cell"), F.col("cell").alias("beyond")).join(inner, ["cell", "beyond"])
        turning = stored(turned.select("node", "cell", F.col("after").alias("beyond")))
        if turning.isEmpty():
            break
    else:
        raise RuntimeError(f"corners not turned after {rounds} rounds")
    ranked = ranked_cycles(found.select(F.lit(0).alias("key"), "node", "next"))
    placed = ranked.select(F.col("loop.cell").alias("loop"), "position", F.col("node.cell").alias("cell"), F.col("node.beyond").alias("beyond"))
    return placed.join(edge.drop("after"), ["cell", "beyond"]).select("loop", "position", "x", "y", "cell", "beyond")
