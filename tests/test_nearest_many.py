"""The nearest of many centres, for far points and points of null coordinates too, against brute force."""

import numpy as np

from stepfield.operators import assign


def test_far_and_null_points_keep_their_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.random((assign.FEW_CENTRES + 5, 2)) * 10
    near = rng.random((60, 2)) * 12 - 1
    far = rng.normal(size=(30, 2)) * 10.0 ** rng.integers(1, 5, (30, 1))
    xy = [*near.tolist(), *far.tolist()]
    rows = [(i, x, y) for i, (x, y) in enumerate(xy)] + [(900, None, 1.0), (901, 1.0, None), (902, None, None)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double")
    for few, some in ((assign.FEW_CENTRES, centres), (1, centres[:3])):
        cells = spark.createDataFrame([(i, *c) for i, c in enumerate(some.tolist())], "cell int, c_x double, c_y double")
        got = {r.row_id: (r.cell, r.distance) for r in assign.nearest(df, cells, few).collect()}
        assert len(got) == len(rows) and all(got[i] == (None, None) for i in (900, 901, 902))
        d = np.hypot(*(np.array(xy)[:, None] - some[None]).transpose(2, 0, 1))
        for i in range(len(xy)):
            assert got[i][0] is not None and d[i, got[i][0]] <= d[i].min() * (1 + 1e-12) and abs(got[i][1] - d[i].min()) < 1e-6
