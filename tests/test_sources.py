"""Readers, writers, the catalog and streams."""

import pytest
from pyspark.sql import functions as F

from stepfield.sources import catalog, locations
from stepfield.streaming import windows


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("n x y t\n1 0.5 1e-1 0.05\n1 0.6 0.2 0.10\n")
    (tmp_path / "b.txt").write_text("1\t2.0\t3.0\t0.05\n2\t2.5\t3.5\tnan\n")
    df = locations.read_xyt(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    rows = sorted((r.n, r.x, r.t) for r in df.where("t is not null").collect())
    assert rows == [(1, 0.5, 0.05), (1, 0.6, 0.1), (2, 2.0, 0.05)]
    assert df.where("t is null").count() == 1
    moved = locations.read_xyt(spark, [str(tmp_path / "a.txt")], reset_origin=True)
    assert moved.agg(F.min("x")).first()[0] == 0


def test_text_errors(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1 0 0 0.05\n1 1 1 0.05\n")
    with pytest.raises(ValueError, match="several locations"):
        locations.read_xyt(spark, str(tmp_path / "c.txt"))
    (tmp_path / "d.txt").write_text("1 0 nan 0.05\n")
    with pytest.raises(ValueError, match="without values"):
        locations.read_xyt(spark, str(tmp_path / "d.txt"))


def test_round_trip(spark, sf, tmp_path):
    df = locations.events(spark, sf)
    locations.write_ascii(df, str(tmp_path / "out"), ["n", "x", "y", "t"])
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).count() == df.count()


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "tree"))
    maps = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "cell int, force_x double, force_y double")
    a = c.add(maps, "grid*", kind="cells", comment="first")
    b = c.add(maps, "maps", parent=a, kind="maps")
    assert (a, b) == ("grid0", "grid0/maps") and c.next_label("grid*") == "grid1"
    assert c.read(b).count() == 2 and c.paths("maps") == [b] and c.find(b, "cells") == a
    c.add(maps.limit(1), "maps", parent=a, kind="maps")
    assert c.read(b).count() == 1
    other = catalog.Catalog(spark, str(tmp_path / "other"))
    assert other.merge(c) == [a, b] and other.merge(c) == []
    assert "maps <maps>" in other.describe()
    assert catalog.features_of(maps.columns) == {"force": ["force_x", "force_y"]}
    assert [r.cell for r in catalog.subset(maps, [1], reindex=True).collect()] == [0]


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 4).cast("int").alias("cell"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.cell_counts(stream, "30 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("counts").agg(F.sum("k"), F.count("*")).first()
    batch = windows.cell_counts(spark.read.parquet(str(tmp_path / "in")), "30 minutes").agg(F.sum("k"), F.count("*")).first()
    assert got == batch and got[0] == 200
