"""Voronoi cells of any centres within a box: polygons, adjacency, volumes, and densities of points by their own cells.

A polygon is exact as soon as no centre is nearer to any of its corners than its own. So a first pass cuts each centre's box by the
centres of its block and of a margin round it; blocks are cut by quantiles, so they hold about as many centres wherever these lie. What a corner's circle
leaves open goes to all blocks that the circle meets, once: each names those of its own centres that cut the polygon, and the polygon is cut by all of
them. A centre that cuts a polygon cuts off a corner, so none is missed. No group of the first pass holds more than GROUP centres: crowded margins are
sliced, which only leaves more to the second."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.operators.boxes import points_in_boxes
from stepfield.sources.storage import stored

#: Centres in a group of the first pass; a quarter of them are a block's own.
GROUP = 16384
#: Cuts of a strip; beyond so many its blocks grow.
CUTS = 4096
POLYGON = "cell long, c_x double, c_y double, v_x array<double>, v_y array<double>, side array<long>, done boolean"
_NAMES = [c.split()[0] for c in POLYGON.split(", ")]


def _clip(corners: list, side: list[int], beyond: list[float], cell: int) -> tuple[list, list[int]]:
    """A convex polygon about the origin without its part of positive `beyond`, given at the corners. side[k] names what lies beyond the edge from corner k to the next."""
    kept, names = [], []
    for k, (x, y) in enumerate(corners):
        s, n = beyond[k], (k + 1) % len(corners)
        if s <= 0:
            kept.append((x, y))
            names.append(side[k])
        if (s <= 0) != (beyond[n] <= 0):
            u = s / (s - beyond[n])
            kept.append((x + (corners[n][0] - x) * u, y + (corners[n][1] - y) * u))
            names.append(cell if s <= 0 else side[k])
    return kept, names


def _cut(corners: list, side: list[int], to: np.ndarray, cell: np.ndarray) -> tuple[list, list[int]]:
    """A convex polygon about the origin without what is nearer to any of the centres `to`, best given from the nearest on."""
    half, at, window = np.einsum("ij,ij->i", to, to) / 2, 0, 64
    while at < len(to):
        own = slice(at, at + window)
        beyond = to[own] @ np.array(corners).T - half[own, None]
        hit = (beyond > 1e-12 * half[own, None]).any(1)
        first = int(hit.argmax())
        if hit[first]:
            corners, side = _clip(corners, side, beyond[first].tolist(), int(cell[at + first]))
            at, window = at + first + 1, 64
        else:
            at, window = at + window, 2 * window
    return corners, side


def _radius(corners: list) -> float:
    return max(math.hypot(x, y) for x, y in corners)


def _carved(corners: list, side: list[int], dx: np.ndarray, dy: np.ndarray, cell: np.ndarray, reach: float) -> tuple[list, list[int]]:
    """The same by all centres that can cut it, whatever their order, in rings: `reach`, then twice as far, until no farther centre can cut."""
    far, before = dx * dx + dy * dy, 0.0  # the centre itself, at 0, is in no ring
    while True:
        ring = np.flatnonzero((far > before) & (far <= reach * reach))
        ring = ring[np.argsort(far[ring], kind="stable")]
        corners, side = _cut(corners, side, np.stack([dx[ring], dy[ring]], 1), cell[ring])
        need = 2 * _radius(corners)
        if need <= reach:
            return corners, side
        before, reach = reach * reach, min(need * (1 + 1e-9), 2 * reach)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=_NAMES)


def _row(cell: int, x: float, y: float, corners: list, side: list[int], done: bool) -> tuple:
    return cell, x, y, [x + u for u, _ in corners], [y + v for _, v in corners], side, done


def _blocks(centres: DataFrame, own: int) -> list[tuple[float, ...]]:
    """(a0, a1, b0, b1) of blocks of about `own` centres each that share out the plane: strips between quantiles of c_x, cut at quantiles of c_y. A block holds
    what lies beyond a0 up to a1, and beyond b0 up to b1."""
    k = centres.count()
    if not k:
        return []
    n = math.ceil(math.sqrt(k / own))
    quantiles = lambda c, n: F.percentile_approx(c, [j / n for j in range(1, n)], 10_000)
    cuts = sorted(set(centres.agg(quantiles("c_x", n)).first()[0])) if n > 1 else []
    strip = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda v: v < F.col("c_x"))) if cuts else F.lit(0)
    placed = centres.select(strip.alias("strip"), "c_y")
    counts = {r.strip: r["count"] for r in placed.groupBy("strip").count().collect()}
    most = min(max(math.ceil(v / own) for v in counts.values()), CUTS)
    found = {r[0]: r[1] for r in placed.groupBy("strip").agg(quantiles("c_y", most)).collect()} if most > 1 else {}
    edges = [-math.inf, *cuts, math.inf]
    out = []
    for s in counts:
        n = min(math.ceil(counts[s] / own), most)
        at = [-math.inf, *sorted({found[s][round(j * most / n) - 1] for j in range(1, n)}), math.inf]
        out += [(edges[s], edges[s + 1], a, b) for a, b in zip(at, at[1:], strict=False)]
    return out


def _dealt(centres: DataFrame, blocks: list[tuple[float, ...]], margin: float) -> tuple[DataFrame, list[tuple[float, ...]]]:
    """centres with `block`, and `own`, a row for each block that holds them with its margin, that share of the root of its area; and the blocks with margins, which
    have no end where there are no centres beyond."""
    x0, x1, y0, y1 = centres.agg(F.min("c_x"), F.max("c_x"), F.min("c_y"), F.max("c_y")).first()
    rows, wide = [], []
    for k, (a, b, c, d) in enumerate(blocks):
        inner = max(a, x0), min(b, x1), max(c, y0), min(d, y1)
        m = margin * math.sqrt((inner[1] - inner[0]) * (inner[3] - inner[2]))
        ends = [e + m * s for e, s in zip(inner, (-1, 1, -1, 1), strict=True)]
        rows.append((k, a, b, c, d, *ends))
        wide.append(tuple(math.inf * s if (e - edge) * s >= 0 else e for e, edge, s in zip(ends, (x0, x1, y0, y1), (-1, 1, -1, 1), strict=True)))
    boxes = centres.sparkSession.createDataFrame(rows, "block int, a double, b double, c double, d double, x_min double, x_max double, y_min double, y_max double")
    near = points_in_boxes(centres.select("cell", F.col("c_x").alias("x"), F.col("c_y").alias("y")), boxes, ["block", "a", "b", "c", "d"])
    own = (F.col("x") > F.col("a")) & (F.col("x") <= F.col("b")) & (F.col("y") > F.col("c")) & (F.col("y") <= F.col("d"))
    return near.select("cell", F.col("x").alias("c_x"), F.col("y").alias("c_y"), "block", own.alias("own")), wide


def _slice(dealt: DataFrame, group: int) -> Column:
    """Slices of those blocks, seldom any, that hold more than `group` centres with their margins."""
    crowded = {r.block: math.ceil(r["count"] / group) for r in dealt.groupBy("block").count().where(F.col("count") > group).collect()}
    if not crowded:
        return F.lit(0)
    many = F.create_map(*(F.lit(v) for item in crowded.items() for v in item))
    return F.when(F.col("block").isin(*crowded), F.pmod(F.xxhash64("cell"), many[F.col("block")]) + 1).otherwise(0).cast("int")


def _first_polygons(centres: DataFrame, blocks: list[tuple[float, ...]], box: tuple[float, float, float, float], group: int) -> DataFrame:
    """Polygons cut by the centres of a block and its margin; done where these are sure to hold all that can cut."""
    x0, x1, y0, y1 = box
    dealt, wide = _dealt(centres, blocks, 0.25)

    def run(table: pa.Table) -> pa.Table:
        cell, own = table.column("cell").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        xs, ys = table.column("c_x").to_numpy(), table.column("c_y").to_numpy()
        a, b, c, d = wide[table.column("block")[0].as_py()]
        whole = table.column("slice")[0].as_py() == 0
        chosen = np.flatnonzero(own)
        chosen = chosen[np.lexsort((xs[chosen], ys[chosen]))]
        reach = 3 * math.sqrt(max(float(np.ptp(xs) * np.ptp(ys)), 1e-12) / len(xs))
        rows = []
        for n in chosen:
            x, y = float(xs[n]), float(ys[n])
            corners, side = _carved([(x0 - x, y0 - y), (x1 - x, y0 - y), (x1 - x, y1 - y), (x0 - x, y1 - y)], [-1, -2, -3, -4], xs - x, ys - y, cell, reach)
            reach = math.sqrt(reach * 2 * _radius(corners))  # its neighbour's is likely to be alike
            done = whole and all(x + u - r >= a and x + u + r <= b and y + v - r >= c and y + v + r <= d for u, v in corners for r in [math.hypot(u, v)])
            rows.append(_row(int(cell[n]), x, y, corners, side, done))
        return pa.Table.from_batches([_record(rows)])

    return dealt.withColumn("slice", _slice(dealt, group)).groupBy("block", "slice").applyInArrow(run, POLYGON)


def _cut_again(batches):
    """Polygons with `by`, the centres that cut them."""
    for b in batches:
        rows = []
        for cell, x, y, vx, vy, side, by in zip(*(b.column(c).to_pylist() for c in ("cell", "c_x", "c_y", "v_x", "v_y", "side", "by")), strict=True):
            corners = [(u - x, v - y) for u, v in zip(vx, vy, strict=True)]
            if by:
                to = np.array([(o["c_x"] - x, o["c_y"] - y) for o in by])
                order = np.lexsort(([o["cell"] for o in by], (to * to).sum(1)))
                corners, side = _cut(corners, side, to[order], np.array([o["cell"] for o in by])[order])
            rows.append(_row(cell, x, y, corners, side, not by))
        yield _record(rows)


def polygons(cells: DataFrame, box: tuple[float, float, float, float], group: int = GROUP) -> DataFrame:
    """cells (cell, c_x, c_y) -> (cell, c_x, c_y, v_x, v_y, side): the cell's corners within box (x_min, x_max, y_min, y_max), counter-clockwise, and
    the cell beyond each edge (-1 to -4: the box). Of centres at one place the smallest cell counts; null centres, and those outside the
    box, have no polygon."""
    x0, x1, y0, y1 = box
    inside = F.col("c_x").between(x0, x1) & F.col("c_y").between(y0, y1)
    centres = stored(cells.where(inside).groupBy("c_x", "c_y").agg(F.min("cell").cast("long").alias("cell")))
    return _polygons(centres, box, group)


def _polygons(centres: DataFrame, box: tuple[float, float, float, float], group: int, only: DataFrame | None = None) -> DataFrame:
    """The same of centres that lie in the box, each at a place of its own; of `only` these cells, if given."""
    blocks = _blocks(centres, max(group // 4, 1))
    if not blocks:
        return centres.sparkSession.createDataFrame([], POLYGON).drop("done")
    first = _first_polygons(centres, blocks, box, group)
    now = stored(first if only is None else first.join(only.hint("merge"), "cell", "left_semi"))
    return now.where("done").drop("done").unionByName(_finished(now.where("not done").drop("done"), centres, blocks))


def _finished(open_: DataFrame, centres: DataFrame, blocks: list[tuple[float, ...]]) -> DataFrame:
    """Polygons cut by all centres that are nearer to a corner than their own, each looked for in the blocks that the corner's circle meets."""
    if open_.isEmpty():
        return open_
    dealt, _ = _dealt(centres, blocks, 0.0)
    owned = dealt.where("own").select("block", "cell", "c_x", "c_y")
    found = {r[0]: r[1:] for r in owned.groupBy("block").agg(F.min("c_x"), F.max("c_x"), F.min("c_y"), F.max("c_y")).collect()}
    name, ends = np.array(list(found), dtype="int32"), np.array([tuple(v) for v in found.values()])

    def meet(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                sizes = np.array([len(v) for v in b.column("v_x").to_pylist()])
                v = np.stack([b.column(c).flatten().to_numpy() for c in ("v_x", "v_y")], 1)
                c = np.repeat(np.stack([b.column(c).to_numpy() for c in ("c_x", "c_y")], 1), sizes, axis=0)
                gap = np.maximum(np.maximum(ends[None, :, 0::2] - v[:, None], v[:, None] - ends[None, :, 1::2]), 0)
                near = np.hypot(gap[..., 0], gap[..., 1]) < np.hypot(*(v - c).T)[:, None]
                row, block = np.nonzero(np.logical_or.reduceat(near, np.cumsum(sizes) - sizes, axis=0))
                sent = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(name[block]), *sent.columns], names=["block", *sent.schema.names])

    def look(polygons: pa.Table, places: pa.Table) -> pa.Table:
        cell, xs, ys = (places.column(c).to_numpy() for c in ("cell", "c_x", "c_y"))
        rows = []
        for own, x, y, vx, vy, side in zip(*(polygons.column(c).to_pylist() for c in ("cell", "c_x", "c_y", "v_x", "v_y", "side")), strict=True):
            corners = [(u - x, v - y) for u, v in zip(vx, vy, strict=True)]
            _, after = _carved(corners, side, xs - x, ys - y, cell, 2 * _radius(corners))
            rows += [(own, c) for c in set(after) - set(side)]
        by = np.array([c for _, c in rows], dtype="int64")
        order = np.argsort(cell)
        hit = order[np.searchsorted(cell, by, sorter=order)]
        return pa.table({"owner": pa.array([o for o, _ in rows], pa.int64()), "cell": pa.array(by), "c_x": pa.array(xs[hit]), "c_y": pa.array(ys[hit])})

    sent = open_.select(*_NAMES[:-1]).mapInArrow(meet, "block int, " + POLYGON.rsplit(", ", 1)[0])
    cutting = sent.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(look, "owner long, cell long, c_x double, c_y double")
    by = cutting.groupBy(F.col("owner").alias("cell")).agg(F.collect_list(F.struct("cell", "c_x", "c_y")).alias("by"))
    return stored(open_.join(by.hint("merge"), "cell", "left").mapInArrow(_cut_again, POLYGON)).drop("done")


def without(cells: DataFrame, gone: DataFrame, box: tuple[float, float, float, float], group: int = GROUP) -> DataFrame:
    """polygons() of the centres left when those of `gone` (cell) are deleted, mended from the polygons before: only cells that had a side towards a
    deleted one are cut again, by the neighbours they keep and by each other, as a cell's new neighbours are among these.
    All other polygons stay as they are."""
    gone = gone.select("cell").distinct()
    left = cells.join(gone.hint("merge"), "cell", "left_anti")
    touched = stored(left.select("cell", F.explode("side").alias("by")).join(gone.withColumnRenamed("cell", "by").hint("merge"), "by").select("cell").distinct())
    again = stored(left.join(touched.hint("merge"), "cell").select("cell", "c_x", "c_y", "side"))
    sides = again.select(F.col("cell").alias("owner"), F.explode("side").alias("cell")).where("cell >= 0")
    kept = stored(sides.join(left.select("cell", "c_x", "c_y").hint("merge"), "cell"))
    centres = stored(again.select("cell", "c_x", "c_y").unionByName(kept.select("cell", "c_x", "c_y")).distinct())
    return left.join(touched.hint("merge"), "cell", "left_anti").unionByName(_polygons(centres, box, group, touched))


def ridges(cells: DataFrame) -> DataFrame:
    """polygons() -> (i, j, ridge, label): cells that share an edge within the box, both directions, and the edge's length."""
    k = F.explode(F.sequence(F.lit(0), F.size("side") - 1)).alias("k")
    end = F.expr("(k + 1) % size(side)")
    length = F.hypot(F.get("v_x", end) - F.get("v_x", "k"), F.get("v_y", end) - F.get("v_y", "k"))
    found = cells.select("cell", "v_x", "v_y", "side", k).select(F.col("cell").alias("i"), F.get("side", "k").alias("j"), length.alias("ridge"))
    found = found.where("j >= 0").groupBy("i", "j").agg(F.sum("ridge").alias("ridge")).where("ridge > 1e-9")
    both = found.select(F.col("i").alias("j"), F.col("j").alias("i"))
    return found.join(both.hint("merge"), ["i", "j"], "left_semi").select("i", "j", "ridge", F.lit(1).alias("label"))


def volumes(cells: DataFrame) -> DataFrame:
    """polygons() -> (cell, volume, closed): area within the box, and whether the box doesn't bound it."""
    twice = F.expr("aggregate(sequence(0, size(side) - 1), 0D, (a, k) -> a + v_x[k] * v_y[(k + 1) % size(side)] - v_x[(k + 1) % size(side)] * v_y[k])")
    return cells.select("cell", (F.abs(twice) / 2).alias("volume"), (~F.exists("side", lambda s: s < 0)).alias("closed"))


def point_densities(df: DataFrame, box: tuple[float, float, float, float], rank: int = 0) -> DataFrame:
    """df (x, y) -> (x, y, k, area, density): at each place the points there, over the area of the place's own Voronoi cell. With rank 1 points
    and areas are those of the place and its neighbours together."""
    some = df.where("x is not null and y is not null")
    places = stored(some.groupBy("x", "y").agg(F.count("*").alias("k")).select(F.monotonically_increasing_id().alias("cell"), F.col("x").alias("c_x"), F.col("y").alias("c_y"), "k"))
    cells = polygons(places, box)
    own = places.join(volumes(cells).hint("merge"), "cell").select("cell", F.col("c_x").alias("x"), F.col("c_y").alias("y"), "k", F.col("volume").alias("area"))
    if rank:
        near = ridges(cells).join(own.select(F.col("cell").alias("j"), F.col("k").alias("nk"), F.col("area").alias("na")).hint("merge"), "j").groupBy(F.col("i").alias("cell")).agg(F.sum("nk").alias("nk"), F.sum("na").alias("na"))
        own = own.join(near.hint("merge"), "cell", "left").select("cell", "x", "y", (F.col("k") + F.coalesce("nk", F.lit(0))).alias("k"), (F.col("area") + F.coalesce("na", F.lit(0.0))).alias("area"))
    return own.select("x", "y", "k", "area", (F.col("k") / F.col("area")).alias("density"))
