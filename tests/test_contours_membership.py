"""Rings, contours and step membership against walks and brute force on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import assign, contours, graph, membership, voronoi


def test_ranked_cycles(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for key, sizes in ((0, [1, 2, 7]), (1, [40, 3])):
        nodes = rng.permutation(sum(sizes) * 3)[: sum(sizes)].tolist()
        for size in sizes:
            own, nodes = nodes[:size], nodes[size:]
            first = own.index(min(own))
            own = own[first:] + own[:first]
            rows += [(key, a, b) for a, b in zip(own, own[1:] + own[:1], strict=True)]
            want |= {(key, a): (own[0], k, size) for k, a in enumerate(own)}
    found = contours.ranked_cycles(spark.createDataFrame(rows, "key int, node long, next long")).collect()
    assert {(r.key, r.node): (r.loop, r.position, r["size"]) for r in found} == want
    assert contours.ranked_cycles(spark.createDataFrame([], "key int, node long, next long")).count() == 0


def test_frontiers_and_rings_on_a_grid(spark):
    nx, ny = 6, 5
    eight, four = graph.grid_edges(spark, nx, ny, diagonal=True), graph.grid_edges(spark, nx, ny)
    far = {(r.centre, r.cell): r.distance for r in contours.frontiers(eight, 2).collect()}
    want = {(a, b): max(abs(a // ny - b // ny), abs(a % ny - b % ny)) for a in range(nx * ny) for b in range(nx * ny)}
    assert far == {k: d for k, d in want.items() if d <= 2}
    rings = {}
    for r in contours.contours(eight, 2, four).collect():
        rings.setdefault(r.centre, {})[r.position] = r.cell
    assert set(rings) == {2 * ny + 2, 3 * ny + 2}
    for centre, ring in rings.items():
        walk = [ring[k] for k in range(16)]
        assert walk[0] == min(walk) and walk[1] == walk[0] + 1
        assert all(abs(a // ny - b // ny) + abs(a % ny - b % ny) == 1 for a, b in zip(walk, walk[1:] + walk[:1], strict=True))
        assert all(want[centre, c] == 2 for c in walk)
    corners = {0, ny - 1, (nx - 1) * ny, nx * ny - 1}  # three neighbours in a triangle; other rings have chords by eight neighbours
    assert {r.centre for r in contours.contours(eight, 1).collect()} == corners


def test_frontier_in_two_pieces_has_no_contour(spark):
    pairs = [(0, k) for k in range(1, 7)] + [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]
    edges = spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "i int, j int")
    assert 0 not in {r.centre for r in contours.contours(edges).collect()}


def slow_contour(polygons):
    """Loops of (cell, beyond), by matching corner to corner on the driver."""
    outer = {r.cell for r in polygons if any(s < 0 for s in r.side)}
    lines = []
    for r in polygons:
        for k, s in enumerate(r.side):
            q = (k + 1) % len(r.side)
            a, b = np.array([r.v_x[k], r.v_y[k]]), np.array([r.v_x[q], r.v_y[q]])
            if r.cell not in outer and s in outer and np.hypot(*(b - a)) > 1e-9:
                lines.append(((r.cell, s), a, b))
    return outer, {name: min(lines, key=lambda o: np.hypot(*(o[1] - b)))[0] for name, _, b in lines}


def test_interior_contour(spark):
    rng = np.random.default_rng(5)
    jittered = [(k, (k // 9) + rng.uniform(-0.3, 0.3), (k % 9) + rng.uniform(-0.3, 0.3)) for k in range(81)]
    square = [(k, float(k // 6), float(k % 6)) for k in range(36)]  # four cells at a corner
    for rows, box, inside in ((jittered, (-1.0, 9.0, -1.0, 9.0), None), (square, (-0.5, 5.5, -0.5, 5.5), 16)):
        cells = voronoi.polygons(spark.createDataFrame(rows, "cell long, c_x double, c_y double"), box).cache()
        outer, after = slow_contour(cells.collect())
        assert {r.cell for r in contours.exterior_cells(cells).collect()} == outer
        found = contours.interior_contour(cells).collect()
        assert {(r.cell, r.beyond) for r in found} == set(after)
        at = {(r.loop, r.position): (r.cell, r.beyond) for r in found}
        sizes = {r.loop: sum(o.loop == r.loop for o in found) for r in found}
        assert all(at[loop, (p + 1) % sizes[loop]] == after[name] for (loop, p), name in at.items())
        assert inside is None or len(found) == inside
    alone = voronoi.polygons(spark.createDataFrame([(0, 0.5, 0.5)], "cell long, c_x double, c_y double"), (0.0, 1.0, 0.0, 1.0))
    assert contours.interior_contour(alone).count() == 0


def slow_shares(p, d, centres):
    """Every cell's interval of the line, cut by every other centre."""
    out = {}
    for i, c in enumerate(centres):
        low, high = 0.0, 1.0
        for j, o in enumerate(centres):
            if i == j:
                continue
            a, b = (p - (c + o) / 2) @ (o - c), d @ (o - c)
            if b > 0:
                high = min(high, -a / b)
            elif b < 0:
                low = max(low, -a / b)
            elif a > 0:
                high = -1.0
        if high - low > 1e-9:
            out[i] = high - low
    return out


@pytest.mark.parametrize("few", [4096, 5])
def test_crossed_cells(spark, monkeypatch, few):
    monkeypatch.setattr(assign.nearest, "__defaults__", (few,))
    rng = np.random.default_rng(few)
    centres = rng.uniform(0, 10, (60, 2))
    rows = [(k // 2, *rng.uniform(0, 10, 2).tolist(), *(rng.normal(0, 3, 2) * (k % 4)).tolist()) for k in range(0, 160, 2)]
    rows.append((999, None, 1.0, 1.0, 1.0))
    steps = spark.createDataFrame(rows, "row_id long, x double, y double, dx double, dy double")
    cells = spark.createDataFrame([(i, *c) for i, c in enumerate(centres.tolist())], "cell int, c_x double, c_y double")
    found = {}
    for r in membership.crossed_cells(steps, cells).collect():
        found.setdefault(r.row_id, {})[r.cell] = r.share
    assert 999 not in found and max(map(len, found.values())) > 4
    for n, x, y, dx, dy in rows[:-1]:
        want = slow_shares(np.array([x, y]), np.array([dx, dy]), centres)
        assert sum(found[n].values()) == pytest.approx(1)
        assert {c: s for c, s in found[n].items() if s > 1e-9} == pytest.approx(want, abs=1e-9)


def test_both_ends(spark):
    steps = spark.createDataFrame([(0, 1, 1), (1, 1, 2), (2, None, 3), (3, None, None)], "row_id int, cell int, cell_to int")
    assert sorted((r.row_id, r.member) for r in membership.both_ends(steps).collect()) == [(0, 1), (1, 1), (1, 2), (2, 3)]


def test_repeated_rows_find_the_nearest_of_many_centres(spark):
    cells = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "cell int, c_x double, c_y double")
    rows = spark.createDataFrame([(0, 3.2, 1.0), (0, 3.2, 1.0), (0, 500.0, 0.0), (1, None, 0.0)], "row_id int, x double, y double")
    for few in (4096, 5):
        found = assign.nearest(rows, cells, few)
        assert sorted(str((r.row_id, r.x, r.cell)) for r in found.collect()) == sorted(map(str, [(0, 3.2, 3), (0, 3.2, 3), (0, 500.0, 9), (1, None, None)]))
