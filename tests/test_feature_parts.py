"""All features are joined from written parts, so no task holds the sorted rows of several."""

from stepfield.operators import features as X


def test_joined_parts_hold_no_windows(spark):
    df = spark.range(60).selectExpr("id % 3 as n", "id as row_id", "cast(id as double) as t", "cast(id * id % 17 as double) as x", "cast(id * 7 % 13 as double) as y")
    out = X.all_features(df, largest=200.0)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.n for r in out.select("n").orderBy("n").collect()] == [0, 1, 2]
