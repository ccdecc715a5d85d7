"""Sliding windows of any feature against loops over rows; streams kept batch by batch; steps in order over ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import features, roi
from stepfield.streaming import windows


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(4)
    sizes = {1: 12, 2: 7, 3: 8, 4: 1, -5: 30}
    rows = [(n, 100 * abs(n) + i, float(i), float(rng.normal()), float(rng.normal())) for n, k in sizes.items() for i in range(k)]
    return rows, spark.createDataFrame(rows, "n long, row_id long, t double, x double, y double")


def hull_of(df):
    return features.convex_hull(df).select("n", "hull_area")


@pytest.mark.parametrize("rows,step", [(7, 1), (6, 1), (6, 3)])
def test_feature_vector(walks, rows, step):
    data, df = walks
    got = {(r.n, r.i): r.hull_area for r in features.feature_vector(df, hull_of, rows, step).collect()}
    want = {}
    for n in {r[0] for r in data}:
        p = np.array([r[3:] for r in data if r[0] == n])
        starts = list(range(0, len(p) - rows, step))
        at = {s + rows // 2: features.hull_measures(p[s : s + rows])[0] for s in starts}
        if starts:
            want |= {(n, i): v for i, v in at.items()}
            want |= {(n, i): at[rows // 2] for i in range(rows // 2)} | {(n, i): at[starts[-1] + rows // 2] for i in range(starts[-1] + rows // 2, len(p))}
    assert got == pytest.approx(want)


def test_mean_by_scale(walks):
    data, df = walks
    got = {(r.n, r["rows"]): r.hull_area for r in features.mean_by_scale(df, hull_of, [4, 9]).collect()}
    want = {}
    for n in {r[0] for r in data}:
        p = np.array([r[3:] for r in data if r[0] == n])
        for k in (4, 9):
            parts = [features.hull_measures(p[s : s + k])[0] for s in range(len(p) - k)]
            if parts:
                want[n, k] = np.mean(parts) / features.hull_measures(p)[0]
    assert got == pytest.approx(want)


def test_hulls_of_nothing(spark):
    none = spark.createDataFrame([], "n long, row_id long, t double, x double, y double")
    assert features.convex_hull(none).count() == 0 and features.feature_vector(none, hull_of, 3).count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_steps_in_order(spark, walks, ranges):
    data, df = walks
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    got = {r.row_id: r.step for r in roi.steps_in_order(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    order = sorted(data, key=lambda r: (r[2], r[1]))
    want = {b[1]: float(np.hypot(b[3] - a[3], b[4] - a[4])) for a, b in zip(order, order[1:], strict=False)}
    assert got.pop(order[0][1]) is None and got == pytest.approx(want)


def test_stream_kept_over_two_runs(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}"
    rows = spark.range(10).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).cast("int").alias("cell"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    counts = []
    for _ in range(2):  # the second run goes on from the first one's progress
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        out = windows.kept(windows.cell_counts(stream, "1 hour", late="1 day"), f"{path}/rows", f"{path}/progress", ["window", "cell"])
        counts.append({r.cell: r.k for r in out.collect()})
    assert counts == [{0: 5, 1: 5}, {0: 10, 1: 10}]
