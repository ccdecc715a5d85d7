"""Ergodicity's lags are looked up in blocks: the rows shuffled don't grow with the number of lags, and blocks lose no pair."""

import math

import numpy as np
import pytest

from stepfield.operators import features as X


def shuffled(spark, df):
    """Rows that df's exchanges write."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(kept, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        df = df.select("*")
        df._jdf.queryExecution().toRdd().count()
        found, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            plan = todo.pop()
            if (rows := plan.metrics().get("shuffleRecordsWritten")).isDefined():
                found += rows.get().value()
            children = plan.children()
            todo += [children.apply(k) for k in range(children.size())]
        return found
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def trajectories(spark):
    """Of 1 to 200 rows; the one of 60 has places that are not known."""
    rng, rows = np.random.default_rng(7), []
    for n, size in enumerate((1, 2, 3, 4, 7, 8, 9, 60, 97, 200)):
        for k, (x, y) in enumerate(rng.normal(size=(size, 2)).cumsum(0).tolist()):
            lost = size == 60 and k % 11
            rows.append((n, len(rows), float(k), None if lost == 3 else x, None if lost == 5 else y))
    return spark.createDataFrame(rows, "n int, row_id int, t double, x double, y double"), rows


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def phases(at, last):
    """Mean cosine and sine over lags of {i: value or None}."""
    m = min(last + 1, 7)
    c, s = [], []
    for lag in {1 + k * (last - 1) // max(m - 1, 1) for k in range(m)}:
        d = [None if at[i] is None or at[i + lag] is None else at[i + lag] - at[i] for i in at if i + lag in at]
        c.append(mean([None if v is None else math.cos(v) for v in d]))
        s.append(mean([None if v is None else math.sin(v) for v in d]))
    return mean(c), mean(s)


def square(values):
    return mean([None if v is None else math.cos(v) for v in values]) ** 2 + mean([None if v is None else math.sin(v) for v in values]) ** 2


def expected(rows):
    minus = lambda a, b: None if a is None or b is None else a - b
    size, out = len(rows), {}
    moved = [minus(b[3], a[3]) for a, b in zip(rows, rows[1:], strict=False)]
    for c, name in ((3, "x"), (4, "y")):
        p = [r[c] for r in rows]
        c2, s2 = phases({i: None if v is None else 2 * v for i, v in enumerate(p)}, size - 1)
        out[f"ergo2_{name}"] = math.hypot(c2 + 1 / size - square([None if v is None else 2 * minus(v, p[0]) for v in p]) / (size * (size + 1)), s2)
        d = [minus(b, a) for a, b in zip(p, p[1:], strict=False)]
        root = math.sqrt(mean([None if v is None else v * v for v in d]))
        steps = {i: None if v is None else v / root for i, v in enumerate(d) if moved[i] is not None}
        out[f"ergo_{name}"] = None
        if size > 2:
            c1, s1 = phases(steps, size - 2)
            out[f"ergo_{name}"] = math.hypot(c1 - square(list(steps.values())), s1)
    return out


@pytest.mark.parametrize("residues", [3, 5, 512])
def test_blocks_lose_no_pair(spark, residues):
    df, rows = trajectories(spark)
    found = {r.n: r for r in X.ergodicity_breaking(df, residues=residues).collect()}
    assert sorted(found) == list(range(1, 10))
    for n, r in found.items():
        for c, v in expected([row for row in rows if row[0] == n]).items():
            assert (r[c] is None) == (v is None) and (v is None or abs(r[c] - v) < 1e-9), (n, c)


def test_rows_shuffled_dont_grow_with_lags(spark):
    df = spark.range(6000).selectExpr("id % 20 as n", "id as row_id", "cast(id as double) as t", "cast(id * id % 17 as double) as x", "cast(id * 7 % 13 as double) as y")
    assert shuffled(spark, X.ergodicity_breaking(df)) < 3 * 6000
