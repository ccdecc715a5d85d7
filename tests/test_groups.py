"""Groups of cells with a margin: against a plain loop, and maps by groups against the whole map."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import graph, groups, infer


def code(x, y):
    return sum(((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1) for b in range(16))


@pytest.mark.parametrize("parts", [1, 5])
def test_against_a_loop(spark, parts):
    rng = np.random.default_rng(1)
    places = {c: (float(x), float(y)) for c, (x, y) in enumerate(rng.uniform(-3, 5, (70, 2)))} | {70: (1.0, 1.0), 71: (1.0, 1.0)}
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 72, (90, 2)) if a != b}
    edges |= {(b, a) for a, b in edges}
    cells = spark.createDataFrame([(c, *p) for c, p in places.items()] + [(99, None, 1.0)], "cell int, c_x double, c_y double").repartition(parts)
    links = spark.createDataFrame([*edges, (3, 99)], "i int, j int").repartition(parts)
    low = np.min(list(places.values()), 0)
    side = np.ptp(list(places.values()), 0).max()
    at = {c: code(*(min(int((v - o) / side * 65536), 65535) for v, o in zip(p, low, strict=True))) for c, p in places.items()}
    order = sorted(places, key=lambda c: (at[c], c))
    want = {}
    for n, c in enumerate(order):
        want[n // 20, c] = 0
    for step in (1, 2):
        for (part, c), d in list(want.items()):
            for i, j in edges:
                if i == c and d == step - 1:
                    want.setdefault((part, j), step)
    got = [tuple(r) for r in groups.groups(cells, links, 20, 2).collect()]
    assert {(p, c): d for p, c, d in got} == want and len(got) == len(want)
    assert Counter(p for p, _, d in got if d == 0) == {0: 20, 1: 20, 2: 20, 3: 12}
    assert groups.groups(cells.limit(0), links, 20).count() == 0
    assert groups.groups(cells, links.limit(0), 200).count() == 72


def test_maps_by_groups_are_near_the_whole(spark):
    rng = np.random.default_rng(6)
    rows = [(c, *(np.sqrt(2 * 0.05 * (0.2 + 0.05 * (c % 6))) * rng.standard_normal(2)).tolist()) for c in range(36) for _ in range(60)]
    steps = spark.createDataFrame(rows, "cell int, dx double, dy double").withColumn("dt", F.lit(0.05))
    cells = infer.statistics(steps).withColumns({"c_x": F.floor(F.col("cell") / 6).cast("double"), "c_y": (F.col("cell") % 6).cast("double")}).cache()
    edges = graph.grid_edges(spark, 6, 6)
    whole, parts, bare = ({r.cell: r.diffusivity for r in df.collect()} for df in (infer.smooth_joined(cells, edges, 20.0, tolerance=1e-5), groups.smooth_by_groups(cells, edges, 20.0, 9, 2, tolerance=1e-5), groups.smooth_by_groups(cells, edges, 20.0, 9, 0, tolerance=1e-5)))
    assert set(parts) == set(whole) == set(range(36))
    off = [np.mean([abs(m[c] / whole[c] - 1) for c in range(36)]) for m in (parts, bare)]
    assert off[0] < 0.01 and off[0] < off[1] / 2
