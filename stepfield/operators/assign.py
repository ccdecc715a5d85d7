"""Points to cells and to time segments: nearest, radius, k-nearest, box and interval joins."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.operators.boxes import points_in_boxes
from stepfield.sources.storage import checkpointed, stored

#: Centres that are tried for every point as one literal array; more are looked up by grid bucket.
FEW_CENTRES = 4096


def nearest(df: DataFrame, cells: DataFrame, few: int = FEW_CENTRES) -> DataFrame:
    """df with `cell`, the nearest centre (ties: the smallest cell), and `distance`. With few centres, an expression over a literal
    array, without shuffle; else a bucketed search."""
    rows = cells.select("cell", "c_x", "c_y").limit(few + 1).collect()
    if len(rows) > few:
        return nearest_bucketed(df, cells)
    if not rows:
        return df.withColumns({"cell": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
    spec = ",".join(f"named_struct('c',{r.cell},'a',{r.c_x!r}D,'b',{r.c_y!r}D)" for r in sorted(rows))
    best = F.expr(f"array_min(transform(array({spec}), k -> named_struct('d', (x-k.a)*(x-k.a)+(y-k.b)*(y-k.b), 'cell', k.c)))")
    return df.withColumn("_b", best).withColumns({"cell": F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("_b.cell")), "distance": F.sqrt("_b.d")}).drop("_b")


def nearest_counts(df: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, k): how many points each centre is nearest to, without centres that are nearest to none. Points of one place are looked up once, after a shuffle by place,
    so the work doesn't hang on how few splits the file of points has; the counts are written, to be read more than once."""
    return stored(nearest(df.groupBy("x", "y").agg(F.count("*").alias("k")), cells).groupBy("cell").agg(F.sum("k").alias("k")))


def nearest_bucketed(df: DataFrame, cells: DataFrame, width: float | None = None, rounds: int = 3) -> DataFrame:
    """The same for many centres: centres are dealt to the 3 x 3 buckets round their own; a centre found within a bucket's width is
    the nearest, points without one are tried again with buckets twice as wide. What `rounds` leave over is searched by boxes of centres.
    Points of a null coordinate have a null cell. Rows are numbered inside, so any may repeat."""
    k, x0, x1, y0, y1 = cells.agg(F.count("*"), F.min("c_x"), F.max("c_x"), F.min("c_y"), F.max("c_y")).first()
    if not k:
        return df.withColumns({"cell": F.lit(None).cast(cells.schema["cell"].dataType), "distance": F.lit(None).cast("double")})
    width = width or max(math.sqrt(max((x1 - x0) * (y1 - y0), 1e-12) / k), 1e-9)
    names = df.columns
    df = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    some = F.col("x").isNotNull() & F.col("y").isNotNull()
    out = df.where(~some).select(*names, F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"), F.lit(None).cast("double").alias("distance"))
    left = df.where(some)
    d = F.hypot(F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y"))
    for _ in range(rounds):
        b = [F.floor(F.col(c) / width).alias(n) for c, n in (("x", "_i"), ("y", "_j"))]
        around = F.expr("explode(flatten(transform(sequence(-1,1), i -> transform(sequence(-1,1), j -> named_struct('i', i, 'j', j)))))")
        dealt = cells.select("cell", "c_x", "c_y", around.alias("o")).select("cell", "c_x", "c_y", (F.floor(F.col("c_x") / width) + F.col("o.i")).alias("_i"), (F.floor(F.col("c_y") / width) + F.col("o.j")).alias("_j"))
        tried = left.select("*", *b).join(dealt, ["_i", "_j"])
        best = tried.withColumn("_d", d).groupBy("_row").agg(F.min(F.struct("_d", "cell")).alias("_b")).where(F.col("_b._d") <= width)
        marked = checkpointed(left.join(best, "_row", "left"))
        out = out.unionByName(marked.where("_b is not null").select(*names, F.col("_b.cell").alias("cell"), F.col("_b._d").alias("distance")))
        left = marked.where("_b is null").drop("_b")
        if left.isEmpty():
            return out
        width *= 2
    return out.unionByName(_nearest_by_boxes(left, cells, (x0, x1, y0, y1)).select(*names, "cell", "distance"))


def _nearest_by_boxes(df: DataFrame, cells: DataFrame, bounds: tuple, side: int = 32) -> DataFrame:
    """Exact for points anywhere: centres lie in at most side x side boxes; a point is joined with the centres of those boxes alone that may
    hold one nearer than the farthest corner of another box. Rows are numbered by _row."""
    x0, x1, y0, y1 = bounds
    at = [F.least(F.floor((F.col(c) - a) / ((b - a) / side or 1.0)), F.lit(side - 1)).cast("int") for c, a, b in (("c_x", x0, x1), ("c_y", y0, y1))]
    boxed = cells.select("cell", "c_x", "c_y", (at[0] * side + at[1]).alias("_box"))
    rows = boxed.groupBy("_box").agg(F.min("c_x"), F.max("c_x"), F.min("c_y"), F.max("c_y")).collect()  # side x side at most
    boxes = "array(" + ",".join(f"named_struct('k',{r[0]},'a',{r[1]!r}D,'b',{r[2]!r}D,'c',{r[3]!r}D,'d',{r[4]!r}D)" for r in sorted(rows)) + ")"
    reach = F.expr(f"array_min(transform({boxes}, q -> hypot(greatest(x - q.a, q.b - x), greatest(y - q.c, q.d - y))))")
    near = F.expr(f"transform(filter({boxes}, q -> hypot(greatest(q.a - x, 0D, x - q.b), greatest(q.c - y, 0D, y - q.d)) <= _reach * (1 + 1e-12D)), q -> q.k)")
    tried = df.withColumn("_reach", reach).withColumn("_box", F.explode(near)).select("_row", "x", "y", "_box").join(boxed, "_box")
    d = F.hypot(F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y"))
    best = tried.groupBy("_row").agg(F.min(F.struct(d.alias("_d"), "cell")).alias("_b"))
    return df.join(best, "_row").withColumns({"cell": F.col("_b.cell"), "distance": F.col("_b._d")}).drop("_b")


def within(df: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """Every pair of a point and a centre no farther apart than the radius: centres are dealt to the buckets of that width round their
    own, points look into their own bucket alone."""
    around = F.expr("explode(flatten(transform(sequence(-1,1), i -> transform(sequence(-1,1), j -> named_struct('i', i, 'j', j)))))")
    b = lambda x, y: (F.floor(F.col(x) / radius).alias("_i"), F.floor(F.col(y) / radius).alias("_j"))
    dealt = cells.select("cell", "c_x", "c_y", *b("c_x", "c_y"), around.alias("o")).select("cell", "c_x", "c_y", (F.col("_i") + F.col("o.i")).alias("_i"), (F.col("_j") + F.col("o.j")).alias("_j"))
    d = F.hypot(F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y"))
    return df.select("*", *b("x", "y")).join(dealt, ["_i", "_j"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_i", "_j", "c_x", "c_y")


def in_boxes(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Points to cells given as boxes (x_min, x_max, y_min, y_max), closed; a point may be in several."""
    return points_in_boxes(df, cells, ["cell"])


def knn_points(assigned: DataFrame, points: DataFrame, cells: DataFrame, least: int) -> DataFrame:
    """(row_id, cell): cells of fewer than `least` own points take the `least` nearest points of all; others keep theirs.

    Points are counted by bucket, at bucket widths that double; the first width suits the middle 98 % along each axis, so points far out don't widen it. A small cell takes the least width at which the 3 x 3 buckets round it hold
    `least` points; these lie within their diagonal, so only points no farther away are candidates, ranked in hashed slices first."""
    own = assigned.groupBy("cell").agg(F.count("*").alias("k"))
    small = checkpointed(cells.join(own, "cell", "left").where(F.coalesce("k", F.lit(0)) < least).select("cell", "c_x", "c_y"))
    big = assigned.where("cell is not null").join(small.select("cell"), "cell", "left_anti").select("row_id", "cell")
    if small.isEmpty():
        return big
    return big.unionByName(_top(_small_candidates(small, points, least), least).select("row_id", "cell"))


def _small_candidates(small: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """(row_id, cell, distance): points that are sure to hold the `least` nearest of each small cell."""
    placed = points.select("row_id", "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    core = [F.percentile_approx(c, [0.01, 0.99], 1000) for c in ("x", "y")]
    n, x0, x1, y0, y1, *core = placed.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), *core).first()
    if not n:
        return placed.limit(0).select("row_id", F.lit(0).cast(small.schema["cell"].dataType).alias("cell"), F.lit(0.0).alias("distance"))
    sides = [b - a for a, b in core]
    width = max(math.sqrt(max(sides[0] * sides[1], 1e-12) * least / n) / 2, max(sides) / 4096, max(x1 - x0, y1 - y0) / 2**40, 1e-9)
    bucket = lambda c: F.floor(F.col(c) / width)
    levels = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(math.log2(max(x1 - x0, y1 - y0) / width + 1)) + 1))).alias("_l")
    wider = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_l")))
    filled = placed.groupBy(bucket("x").alias("_i"), bucket("y").alias("_j")).agg(F.count("*").alias("k"))
    filled = filled.select("_i", "_j", "k", levels).groupBy("_l", wider("_i").alias("_u"), wider("_j").alias("_v")).agg(F.sum("k").alias("k"))
    around = F.explode(F.expr("flatten(transform(sequence(-1,1), i -> transform(sequence(-1,1), j -> named_struct('i', i, 'j', j))))")).alias("_o")
    looked = small.select("cell", bucket("c_x").alias("_i"), bucket("c_y").alias("_j"), levels).select("cell", "_l", wider("_i").alias("_u"), wider("_j").alias("_v"), around)
    looked = looked.select("cell", "_l", (F.col("_u") + F.col("_o.i")).alias("_u"), (F.col("_v") + F.col("_o.j")).alias("_v"))
    enough = looked.join(filled, ["_l", "_u", "_v"]).groupBy("cell", "_l").agg(F.sum("k").alias("k")).where(F.col("k") >= least).groupBy("cell").agg(F.min("_l").alias("_l"))
    # cells with no such square lie outside the points, or ask for more than there are: their radius reaches all
    far = F.greatest(F.abs(F.col("c_x") - x0), F.abs(F.col("c_x") - x1)) + F.greatest(F.abs(F.col("c_y") - y0), F.abs(F.col("c_y") - y1))
    ready = checkpointed(small.join(enough, "cell", "left").withColumn("_r", F.coalesce(F.pow(F.lit(2.0), F.col("_l")) * (2 * width * math.sqrt(2)), far)))
    corners = [F.col(f"c_{c}") + s * F.col("_r") for c in ("x", "y") for s in (-1, 1)]
    boxes = ready.select("cell", "c_x", "c_y", "_r", *(F.greatest(F.least(e, F.lit(hi)), F.lit(lo)).alias(n) for e, n, lo, hi in zip(corners, ("x_min", "x_max", "y_min", "y_max"), (x0, x0, y0, y0), (x1, x1, y1, y1), strict=True)))
    d = F.hypot(F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y"))
    return points_in_boxes(placed, boxes, ["cell", "c_x", "c_y", "_r"]).withColumn("distance", d).where(F.col("distance") <= F.col("_r")).select("row_id", "cell", "distance")


def _top(pairs: DataFrame, most: Column | int, slices: int = 64) -> DataFrame:
    """The rows (row_id, cell, distance) that are among the `most` nearest of their cell. Hashed slices of a cell are ranked first, so no task
    sorts a crowded cell."""
    order = (F.col("distance"), F.col("row_id"))
    local = pairs.withColumn("_s", F.pmod(F.xxhash64("row_id"), F.lit(slices))).withColumn("_r", F.row_number().over(Window.partitionBy("cell", "_s").orderBy(*order))).where(F.col("_r") <= most)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).where(F.col("_r") <= most).drop("_r", "_s")


def cap_points(assigned: DataFrame, most: int) -> DataFrame:
    """The `most` closest points of each cell."""
    return _top(assigned, most)


def max_radius(assigned: DataFrame, radius: float) -> DataFrame:
    return assigned.where(F.col("distance") <= radius)


def min_count(assigned: DataFrame, least: int) -> DataFrame:
    """Without the points of cells that have fewer than `least`."""
    return assigned.join(assigned.groupBy("cell").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("cell"), "cell", "left_semi")


def bounded_by(assigned: DataFrame, limits: DataFrame) -> DataFrame:
    """Per-cell bounds (cell, least, most, radius; null: none) on counts and distance. Counts are aggregated before the join, ranks taken in slices first."""
    b = assigned.join(limits, "cell", "left").where(F.col("radius").isNull() | (F.col("distance") <= F.col("radius")))
    enough = b.groupBy("cell", "least").agg(F.count("*").alias("_k")).where(F.col("least").isNull() | (F.col("_k") >= F.col("least"))).select("cell")
    b = b.join(enough, "cell", "left_semi")
    return b.where("most is null").unionByName(_top(b.where("most is not null"), F.col("most"))).drop("least", "most", "radius")


def active_only(assigned: DataFrame, cells: DataFrame) -> DataFrame:
    """Without the points of cells whose label is not positive."""
    return assigned.join(cells.where("label > 0").select("cell"), "cell", "left_semi")


def one_cell(pairs: DataFrame) -> DataFrame:
    """m:n pairs (row_id, cell, distance) to one row per point: the nearest cell."""
    return pairs.groupBy("row_id").agg(F.min(F.struct("distance", "cell")).alias("b")).select("row_id", F.col("b.cell").alias("cell"))


def counts(assigned: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, k) for every cell, empty ones included."""
    return cells.select("cell").join(assigned.where("cell is not null").groupBy("cell").agg(F.count("*").alias("k")), "cell", "left").fillna(0, ["k"])


def centroids(assigned: DataFrame) -> DataFrame:
    return assigned.where("cell is not null").groupBy("cell").agg(F.count("*").alias("k"), F.avg("x").alias("m_x"), F.avg("y").alias("m_y"))


def segments(start: float, stop: float, duration: float, shift: float | None = None) -> list[tuple[int, float, float]]:
    """(seg, t0, t1) of a sliding window."""
    shift = shift or duration
    return [(k, start + k * shift, start + k * shift + duration) for k in range(max(1, round((stop - start - duration) / shift) + 1))]


def windows(df: DataFrame, start: float, stop: float, duration: float, shift: float | None = None) -> DataFrame:
    """df with `seg`, a row for every half-open window [start + seg shift, + duration) that its t is in; computed, not joined."""
    shift = shift or duration
    last = len(segments(start, stop, duration, shift)) - 1
    since = F.col("t") - F.lit(start)
    first = F.greatest(F.floor((since - duration) / shift) + 1, F.lit(0))
    end = F.least(F.floor(since / shift), F.lit(last))
    some = F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("seg", F.explode(some.cast("array<int>")))


def in_segments(df: DataFrame, segs: DataFrame) -> DataFrame:
    """Interval join with segments (seg, t0, t1), half-open, which may overlap."""
    return points_in_boxes(df, segs.select("seg", F.col("t0").alias("t_min"), F.col("t1").alias("t_max")), ["seg"], ("t",), open_end=True)


def _spans(timed: DataFrame, buckets: int) -> tuple[list[float], list[int]]:
    """Edges of spans of time that hold about as many rows each, wherever the rows lie, and the rows before each edge. A time that many rows share is a
    span by itself."""
    shares = ",".join(f"{i / buckets!r}D" for i in range(buckets + 1))
    cuts = timed.agg(F.expr(f"percentile_approx(t, array({shares}), {10 * buckets})"), F.min("t"), F.max("t")).first()
    if cuts[1] is None:
        return [], []
    crowded = {a for a, b in zip(cuts[0], cuts[0][1:], strict=False) if a == b} | {cuts[2]}
    edges = sorted({cuts[1], *cuts[0], *crowded, *(math.nextafter(t, math.inf) for t in crowded)})
    at = Bucketizer(splits=[-math.inf, *edges], inputCol="t", outputCol="_b").transform(timed)
    filled = {int(r._b) - 1: r.k for r in at.groupBy("_b").agg(F.count("*").alias("k")).collect()}
    return edges, [0, *accumulate(filled.get(b, 0) for b in range(len(edges) - 1))]


def _reach(mid: float, k: int, edges: list[float], before: list[int]) -> float:
    """About the least distance within which whole spans hold k rows."""
    held = lambda r: before[bisect_right(edges, mid + r) - 1] - before[bisect_left(edges, mid - r)] if edges[0] <= mid + r and mid - r <= edges[-1] else 0
    low, high = 0.0, max(abs(edges[0] - mid), abs(edges[-1] - mid)) * (1 + 1e-12)
    for _ in range(100):
        r = (low + high) / 2
        low, high = (low, r) if held(r) >= k else (r, high)
    return high


def time_candidates(df: DataFrame, segs: Sequence[tuple[int, float, float]], k: int, buckets: int = 4096) -> DataFrame:
    """(row_id, cell, distance): for each segment, as `cell`, rows that are sure to hold the k nearest to its middle in time; about k of them and the rows of three
    spans, of `buckets` of equal count. Of a time that more than a span's rows share, only the k least rows count."""
    timed = df.select("row_id", F.col("t").cast("double").alias("t")).where("t is not null and not isnan(t)")
    edges, before = _spans(timed, buckets)
    if not edges or not segs:
        return timed.limit(0).select("row_id", F.lit(0).alias("cell"), F.lit(0.0).alias("distance"))
    shared = [a for a, b, x, y in zip(edges, edges[1:], before, before[1:], strict=False) if b == math.nextafter(a, math.inf) and y - x > k]
    if shared:
        same = F.col("t").isin(shared)
        least = _top(timed.where(same).select("row_id", F.col("t").alias("cell"), F.lit(0.0).alias("distance")), k)
        timed = timed.where(~same).unionByName(least.select("row_id", F.col("cell").alias("t")))
    ranges = []
    for seg, a, b in segs:
        mid = (a + b) / 2
        reach = _reach(mid, min(k, before[-1]), edges, before)
        ranges.append((seg, mid, mid - reach, mid + reach))
    spans = df.sparkSession.createDataFrame(ranges, "seg int, mid double, t_min double, t_max double")
    return points_in_boxes(timed, spans, ["seg", "mid"], ("t",)).select("row_id", F.col("seg").alias("cell"), F.abs(F.col("t") - F.col("mid")).alias("distance"))


def time_knn(df: DataFrame, segs: Sequence[tuple[int, float, float]], k: int, buckets: int = 4096) -> DataFrame:
    """(seg, row_id, rank): the k rows nearest in time to the middle of each segment (ties: the least rows); slices of the candidates are ranked first."""
    ranked = _top(time_candidates(df, segs, k, buckets), k).withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("distance", "row_id")))
    return ranked.select(F.col("cell").alias("seg"), "row_id", "rank")


def combined_id(ncells: int):
    """seg and cell as one number, and back."""
    return (F.col("seg") * ncells + F.col("cell")).cast("long")


def split_id(df: DataFrame, ncells: int, column: str = "id") -> DataFrame:
    return df.withColumns({"seg": F.floor(F.col(column) / ncells).cast("int"), "cell": (F.col(column) % ncells).cast("int")})


def combine_segments(maps: Sequence[DataFrame], ncells: int) -> DataFrame:
    """Maps of successive segments in one table with combined ids."""
    out = None
    for s, m in enumerate(maps):
        one = m.withColumn("id", (F.lit(s) * ncells + F.col("cell")).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def equal_count_segments(df: DataFrame, per_segment: int) -> DataFrame:
    """(frame time t, k, seg): frames cut into segments of about equal numbers of locations, in order of time."""
    from stepfield.operators.trajectory import offsets

    frames = df.groupBy("t").agg(F.count("*").alias("k")).withColumn("_q", F.round(F.col("t") * 1e3).cast("long"))
    base = offsets(frames, "_q", "k")
    return base.select("t", "k", F.floor(F.col("base") / per_segment).cast("int").alias("seg"))


def nested(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Children (parent, child, ...) numbered across parents: `cell` counts the children of smaller parents, then their own place."""
    from stepfield.operators.trajectory import offsets

    counts = parents.select(F.col("cell").alias("parent")).join(children.groupBy("parent").agg(F.count("*").alias("k")), "parent", "left").fillna(0, ["k"])
    return children.join(offsets(counts, "parent", "k").select("parent", "base"), "parent").withColumn("cell", (F.col("base") + F.row_number().over(Window.partitionBy("parent").orderBy("child")) - 1).cast("int")).drop("base")


def where_cells(assigned: DataFrame, holds: Column) -> DataFrame:
    """Rows of the cells for whose points an aggregate condition holds."""
    kept = assigned.groupBy("cell").agg(holds.alias("_holds")).where("_holds").select("cell")
    return assigned.join(kept, "cell", "left_semi")
