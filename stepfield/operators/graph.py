"""Cell graphs as edge tables (i, j, label), both directions stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.operators.boxes import pair_tasks
from stepfield.sources.storage import checkpointed, stored

#: So many links of cells are held by every task.
LINKS = 1_000_000


def grid_edges(spark: SparkSession, nx: int, ny: int, diagonal: bool = False) -> DataFrame:
    """Edges of a grid numbered row by row: 4 neighbours of a cell, or 8."""
    around = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if diagonal else [])
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around)))
    at = spark.range(nx * ny).select(F.col("id").alias("i"), F.floor(F.col("id") / ny).alias("x"), (F.col("id") % ny).alias("y"), o.alias("o"))
    to = at.select("i", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y")).where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))
    return to.select(F.col("i").cast("int"), (F.col("x") * ny + F.col("y")).cast("int").alias("j"), F.lit(1).alias("label"))


def hexagon_edges(cells: DataFrame) -> DataFrame:
    """Edges of cells (cell, row, col) whose odd rows are shifted: two in the row, two above and two below."""
    odd = F.col("row") % 2
    near = F.explode(F.array(*(F.struct((F.col("row") + dr).alias("row"), (F.col("col") + c).alias("col")) for dr, c in ((0, F.lit(-1)), (0, F.lit(1)), (1, odd - 1), (1, odd), (-1, odd - 1), (-1, odd)))))
    return cells.select(F.col("cell").alias("i"), near.alias("o")).select("i", "o.row", "o.col").join(cells.select(F.col("cell").alias("j"), "row", "col"), ["row", "col"]).select("i", "j", F.lit(1).alias("label"))


def two_hops(edges: DataFrame, paths: int = 1) -> DataFrame:
    """Pairs that are not neighbours and have at least `paths` common neighbours."""
    e = edges.select("i", "j").distinct()
    pairs = e.join(e.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").where("i <> k").groupBy("i", "k").agg(F.count("*").alias("paths")).where(F.col("paths") >= paths)
    return pairs.join(e.withColumnRenamed("j", "k"), ["i", "k"], "left_anti").select("i", F.col("k").alias("j"), "paths")


def usable(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges of positive label between cells of positive label."""
    ok = cells.where("label > 0").select("cell")
    return edges.where("label > 0").join(ok.withColumnRenamed("cell", "i"), "i", "left_semi").join(ok.withColumnRenamed("cell", "j"), "j", "left_semi")


def degree(edges: DataFrame, cells: DataFrame) -> DataFrame:
    return cells.select("cell").join(edges.groupBy(F.col("i").alias("cell")).agg(F.count("*").alias("degree")), "cell", "left").fillna(0, ["degree"])


def neighbours(edges: DataFrame, cells: int | DataFrame) -> DataFrame:
    """(j, label) of the neighbours of a cell, or (i, j, label) of those of every `cell` of a table."""
    if isinstance(cells, DataFrame):
        return edges.join(cells.select(F.col("cell").alias("i")).distinct(), "i", "left_semi").select("i", "j", "label")
    return edges.where(F.col("i") == cells).select("j", "label")


def space_time_edges(edges: DataFrame, cells: DataFrame, segments: int, past: int = -1, future: int = -2) -> DataFrame:
    """Spatial edges in every segment, and edges of each cell to itself in the segments before and after."""
    seg = F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))
    space = edges.select(seg.alias("seg_i"), "i", "j", "label").withColumn("seg_j", F.col("seg_i"))
    own = cells.select(seg.alias("seg_i"), F.col("cell").alias("i"), F.explode(F.array(F.struct(F.lit(-1).alias("d"), F.lit(past).alias("label")), F.struct(F.lit(1).alias("d"), F.lit(future).alias("label")))).alias("o"))
    time = own.select("seg_i", "i", F.col("i").alias("j"), "o.label", (F.col("seg_i") + F.col("o.d")).alias("seg_j")).where(F.col("seg_j").between(0, segments - 1))
    return space.unionByName(time).select("seg_i", "i", "seg_j", "j", "label")


def offset_union(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Block-diagonal union: edges of parts of given numbers of cells."""
    out, base = None, 0
    for edges, cells in parts:
        one = edges.select((F.col("i") + base).cast("int").alias("i"), (F.col("j") + base).cast("int").alias("j"), "label")
        out, base = one if out is None else out.unionByName(one), base + cells
    return out


def set_label(edges: DataFrame, i: int, j: int, label: int | None) -> DataFrame:
    """Adds, relabels or (None) removes an edge, in both directions."""
    rest = edges.where(~(((F.col("i") == i) & (F.col("j") == j)) | ((F.col("i") == j) & (F.col("j") == i))))
    return rest if label is None else rest.unionByName(edges.sparkSession.createDataFrame([(i, j, label), (j, i, label)], edges.schema))


def set_labels(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds, relabels or (null label) removes the edges of `changes` (i, j, label), in both directions; each of them must be there once."""
    both = changes.select("i", "j", "label").unionByName(changes.select(F.col("j").alias("i"), F.col("i").alias("j"), "label"))
    return edges.join(both, ["i", "j"], "left_anti").select("i", "j", "label").unionByName(both.where("label is not null"))


def dilation(edges: DataFrame, start: list[int] | DataFrame, steps: int) -> DataFrame:
    """(cell, distance) of the cells within a number of steps of the start, a list or a table with `cell`. Each step's new cells are written, so plans don't
    grow with the steps."""
    if not isinstance(start, DataFrame):
        start = edges.sparkSession.createDataFrame([(c,) for c in start], "cell int")
    edges = checkpointed(edges.select("i", "j"))
    seen = front = checkpointed(start.select("cell", F.lit(0).alias("distance")).distinct())
    for k in range(1, steps + 1):
        near = edges.join(front.select(F.col("cell").alias("i")), "i").select(F.col("j").alias("cell")).distinct()
        front = checkpointed(near.join(seen.select("cell"), "cell", "left_anti").withColumn("distance", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def point_adjacency(assigned: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Pairs of points of the same or of adjacent cells that are no farther apart than the radius. Points look each other up by bucket of the radius,
    whatever their cells, so a crowded cell makes no all-pairs join; two buckets meet once, so a point is copied five times however many neighbours its cell has. They are
    joined by sorting: Spark's guess of a table's size, from its file, may be far too low to hold a side in every task."""
    placed = assigned.where("cell is not null and x is not null and y is not null")
    links = stored(edges.select("i", "j").unionByName(placed.select(F.col("cell").alias("i"), F.col("cell").alias("j")).distinct()).distinct())
    b = lambda c, d: F.floor((F.col(c) + d * radius) / radius)
    left = placed.select(F.col("row_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cell").alias("i"))
    half = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    left = left.select("*", F.explode(F.array(*(F.struct(b("ax", p).alias("u"), b("ay", q).alias("v"), F.lit(p == q == 0).alias("own")) for p, q in half))).alias("o")).select("a", "ax", "ay", "i", "o.*")
    right = placed.select(F.col("row_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cell").alias("j"), b("x", 0).alias("u"), b("y", 0).alias("v"))
    tasks = pair_tasks(placed.count())
    left, right = (side.repartition(tasks, "u", "v") for side in (left, right))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    near = left.join(right.hint("merge"), ["u", "v"]).where("not own or a < b").withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= radius)
    first = F.col("a") < F.col("b")
    near = near.select(*(F.when(first, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in ("ab", "ba", "ij", "ji")), "distance")
    own = F.broadcast(links) if links.count() <= LINKS else links.hint("merge")
    return near.join(own, ["i", "j"]).select("a", "b", "distance")


def least_reachable(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """nodes (node) and undirected edges (i, j) -> (node, least): the least node that each one reaches. Labels spread to neighbours and halve their paths
    by jumping, so a chain of n nodes takes about 2 log2(n) rounds; raises if `rounds` don't settle it."""
    edges = checkpointed(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    label, last = nodes.select("node", F.col("node").alias("least")), None
    for _ in range(rounds):
        near = edges.join(label.select(F.col("node").alias("j"), "least"), "j").groupBy(F.col("i").alias("node")).agg(F.min("least").alias("near"))
        low = label.join(near, "node", "left").select("node", "least", F.least("least", F.coalesce("near", "least")).alias("low"))
        hung = low.groupBy(F.col("least").alias("node")).agg(F.min("low").alias("hung"))  # what any follower of a label found holds for the label too
        low = low.join(hung, "node", "left").select("node", F.least("low", F.coalesce("hung", "low")).alias("low"))
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        label = checkpointed(low.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("least")))
        now = label.agg(F.count("*"), F.sum(F.xxhash64("node", "least").cast("decimal(38,0)"))).first()
        if now == last:
            return label
        last = now
    raise RuntimeError(f"labels not settled after {rounds} rounds")


def sign_groups(edges: DataFrame, values: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected groups of cells whose value has the same sign: (cell, group), the group being its smallest cell. Cells of null value have
    none. Raises if `rounds` don't settle it."""
    v = values.where("value is not null").select("cell", F.signum("value").alias("s"))
    e = edges.join(v.select(F.col("cell").alias("i"), F.col("s").alias("si")), "i").join(v.select(F.col("cell").alias("j"), F.col("s").alias("sj")), "j").where("si = sj").select("i", "j")
    return least_reachable(v.select(F.col("cell").alias("node")), e, rounds).select(F.col("node").alias("cell"), F.col("least").alias("group"))
