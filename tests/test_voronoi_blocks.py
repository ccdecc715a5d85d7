"""Polygons cut by blocks of quantiles: one pass over the places and one over what it leaves open, however these lie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import voronoi

BOX = (0.0, 500.0, 0.0, 20.0)


def places(kind):
    rng = np.random.default_rng(5)
    at = np.stack([rng.exponential(50, 1500).round(2), rng.integers(0, 20, 1500)], 1) if kind == "lines" else rng.normal((50, 10), (3, 1), (1500, 2))
    if kind == "cluster":
        at[:900] = (60, 9) + at[:900] / 1e6
    at = np.unique(at[(at[:, 0] <= 500) & (at[:, 0] >= 0)], axis=0)
    return [(k, float(x), float(y)) for k, (x, y) in enumerate(at)]


@pytest.mark.parametrize("kind", ["lines", "blob", "cluster"])
def test_two_passes(spark, monkeypatch, kind):
    cells = spark.createDataFrame(places(kind), "cell long, c_x double, c_y double")
    written, stored = [], voronoi.stored
    monkeypatch.setattr(voronoi, "stored", lambda df: written.append(stored(df)) or written[-1])
    area = lambda found: {r.cell: r.volume for r in voronoi.volumes(found).collect()}
    whole = area(voronoi.polygons(cells, BOX))  # one block
    written.clear()
    cut = area(voronoi.polygons(cells, BOX, group=512))
    assert cut == pytest.approx(whole, rel=1e-6, abs=1e-9) and abs(sum(cut.values()) - 10_000) < 1e-6
    assert len(written) == 3  # the places, the first pass, the second
    if kind != "cluster":
        assert written[1].where("done").count() > 0.6 * len(whole)


def test_blocks_share_out_the_places(spark):
    rows = places("lines") + [(9000 + k, 7.0, k / 100) for k in range(2000)]
    centres = spark.createDataFrame(rows, "cell long, c_x double, c_y double")
    dealt, _ = voronoi._dealt(centres, voronoi._blocks(centres, 100), 0.0)
    own = dealt.where("own")
    assert own.count() == len(rows) == own.select("cell").distinct().count()
    assert own.groupBy("block").count().agg(F.max("count")).first()[0] <= 300
