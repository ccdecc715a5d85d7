"""Hulls of many groups are found together, each as it is alone."""

import numpy as np
import pytest

from stepfield.operators import features as X


def groups():
    rng = np.random.default_rng(3)
    circle = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    arc = np.linspace(-1, 1, 400)
    line = np.arange(9.0)
    out = [rng.normal(size=(k, 2)) for k in (1, 2, 3, 5, 40, 500)]
    out += [rng.integers(0, 4, size=(60, 2)).astype(float), np.ones((5, 2)), np.stack([line, 3 * line], 1), np.stack([0 * line, line], 1), np.stack([np.cos(circle), np.sin(circle)], 1)]
    return [*out, np.concatenate([np.stack([arc, arc * arc], 1), [[5.0, -900.0]]])]  # the last one's chain is taken back corner by corner


def test_hulls_of_all_groups():
    parts = groups()
    group, points = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts)
    mixed = np.random.default_rng(4).permutation(len(points))
    at = mixed[X._hulls(group[mixed], points[mixed])]
    assert (np.diff(group[at]) >= 0).all()
    measures = np.stack(X._measured(group[at], points[at]), 1)
    for k, p in enumerate(parts):
        own, alone = points[at[group[at] == k]], X._hull(p)
        assert len(own) == len(alone) and {*map(tuple, own.tolist())} == {*map(tuple, alone.tolist())}
        assert measures[k] == pytest.approx([*X.hull_measures(p), X.hull_diameter(p)], abs=1e-12)
    assert len(X._hulls(np.zeros(0, int), np.zeros((0, 2)))) == 0


def test_groups_are_not_called_one_at_a_time(spark):
    parts = groups()
    rows = [(f"g{k}", float(x), float(y)) for k, p in enumerate(parts) for x, y in p]
    df = spark.createDataFrame([*rows, ("g0", None, 1.0), (None, 1.0, 1.0), ("none", None, None)], "n string, x double, y double").repartition(3)
    out = X.convex_hull(df)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.n: r for r in out.collect()}
    assert sorted(found) == sorted(f"g{k}" for k in range(len(parts)))
    for k, p in enumerate(parts):
        r = found[f"g{k}"]
        assert [r.hull_area, r.hull_perimeter, r.hull_diameter] == pytest.approx([*X.hull_measures(p), X.hull_diameter(p)], abs=1e-12)


def test_groups_are_dealt_whole():
    import pyarrow as pa

    n = [0, 0, 1, 2, 2, 2, 2, 2, 3, 4, 4, 5]
    for cut in (1, 2, 3, 5, 12):
        batches = [pa.RecordBatch.from_pydict({"n": n[k : k + cut], "i": list(range(len(n)))[k : k + cut]}) for k in range(0, len(n), cut)]
        dealt = [t.to_pydict() for t in X.whole_groups([b for b in batches for b in (b.slice(0, 0), b)], ("n",))]
        assert sum((t["i"] for t in dealt), []) == list(range(len(n)))
        assert len({v for t in dealt for v in set(t["n"])}) == sum(len(set(t["n"])) for t in dealt)
