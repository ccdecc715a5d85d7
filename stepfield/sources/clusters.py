"""Text files of cells with their neighbours and steps (.cluster), and of maps (.vmesh).

A .cluster file is a series of blocks of lines: `ZONE: 1`, fields as `X-CENTRE: 0.5`, then a line `DX DY DT` and a line per step. It is read by lines, in as many
splits as Spark makes of it: each line takes the last zone before it, within its split by a window, and from earlier splits by a table of one row a split.
So no task holds a zone. It is written by lines too, ranged by zone and step, so a zone may go on in the next part file; parts are read in order of their names.
Zones count from 1, cells from 0."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfield.sources.storage import stored

# Names of the fields, and the label of the edges to the neighbours of a side.
FIELDS = {"NUMBER_OF_TRANSLOCATIONS": "k", "X-CENTRE": "c_x", "Y-CENTRE": "c_y", "AREA": "area", "AREA_CONVHULL": "volume"}
SIDES = {"LEFT": -1, "RIGHT": 1, "TOP": 2, "BOTTOM": -2}
MAP_COLUMNS = {"Zone ID": "cell", "Translocations": "k", "x-Centre": "c_x", "y-Centre": "c_y", "Diffusion": "diffusivity", "x-Force": "force_x", "y-Force": "force_y", "Potential": "potential"}
_NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|[Nn]a[Nn]|[-+]?[Ii]nf(inity)?"
_STEP = rf"^({_NUMBER})\s+({_NUMBER})\s+({_NUMBER})$"


class Clusters(NamedTuple):
    """cells (cell, k, c_x, c_y, area, volume), edges (i, j, label) and steps (cell, row_id, dx, dy, dt); declared (cell, what, declared): the numbers of steps and
    neighbours that the file states."""

    cells: DataFrame
    edges: DataFrame
    steps: DataFrame
    declared: DataFrame


def _zoned(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    lines = spark.read.text(paths).select(value.alias("value"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row_id"))
    lines = stored(lines.where("value <> '' AND NOT value RLIKE '^[#;]'").withColumn("zone", F.regexp_extract("value", r"^ZONE:\s*(-?\d+)", 1).try_cast("long")), "lines")
    last = lines.groupBy("source", "block").agg(F.max_by("zone", F.when(F.col("zone").isNotNull(), F.col("row_id"))).alias("last"))
    before = Window.partitionBy(F.lit(0)).orderBy("source", "block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("source", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    own = F.last("zone", ignorenulls=True).over(Window.partitionBy("source", "block").orderBy("row_id"))
    return lines.withColumn("own", own).join(carried, ["source", "block"]).select("row_id", "value", (F.coalesce("own", "carried") - 1).cast("int").alias("cell"))


def read_cluster(spark: SparkSession, paths: str | list[str]) -> Clusters:
    """The cells of one data set, in one file or several. Empty lines, those that begin with # or ;, unknown fields, and lines before the first zone
    are passed over; absent fields are null; a field given twice keeps its largest value."""
    lines = _zoned(spark, paths).where("cell IS NOT NULL")
    part = lambda n: F.element_at(F.split("value", r"\s+"), n).cast("double")
    steps = lines.where(F.col("value").rlike(_STEP)).select("cell", "row_id", part(1).alias("dx"), part(2).alias("dy"), part(3).alias("dt"))
    fields = lines.where(F.col("value").rlike("^[A-Z_-]+:")).select("cell", F.substring_index("value", ":", 1).alias("key"), F.regexp_extract("value", r"^[^:]*:\s*(.*)$", 1).alias("text"))
    cells = fields.groupBy("cell").agg(*(F.max(F.when(F.col("key") == key, F.col("text").try_cast("double"))).alias(c) for key, c in FIELDS.items())).withColumn("k", F.col("k").cast("long"))
    label = F.create_map(*(x for s, v in SIDES.items() for x in (F.lit(f"{s}_NEIGHBOURS"), F.lit(v))))
    near = fields.where(F.col("key").isin([f"{s}_NEIGHBOURS" for s in SIDES]) & (F.col("text") != ""))
    edges = near.select(F.col("cell").alias("i"), F.explode(F.split("text", r"\s+")).alias("j"), label[F.col("key")].alias("label")).select("i", (F.col("j").try_cast("int") - 1).alias("j"), "label").where("j IS NOT NULL")
    declared = fields.where(F.col("key").startswith("NUMBER_OF_")).select("cell", F.regexp_extract("key", "^NUMBER_OF_(.*)$", 1).alias("what"), F.col("text").try_cast("long").alias("declared"))
    return Clusters(cells, edges, steps, declared)


def mismatches(found: Clusters) -> DataFrame:
    """(cell, what, declared, found): where a file states another number of steps, or of neighbours of a side, than it holds."""
    side = F.create_map(*(x for s, v in SIDES.items() for x in (F.lit(v), F.lit(f"{s}_NEIGHBOURS"))))
    here = found.steps.select("cell", F.lit("TRANSLOCATIONS").alias("what")).unionByName(found.edges.select(F.col("i").alias("cell"), side[F.col("label")].alias("what")))
    counts = here.groupBy("cell", "what").agg(F.count("*").alias("found"))
    return found.declared.join(counts, ["cell", "what"], "left").fillna(0, ["found"]).where("declared <> found")


def sided(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """edges (i, j) labelled by the side of i on which j lies: along the axis on which the centres are farther apart, x on a tie."""
    at = lambda c: cells.select(F.col("cell").alias(c), F.col("c_x").alias(f"x_{c}"), F.col("c_y").alias(f"y_{c}"))
    dx, dy = F.col("x_j") - F.col("x_i"), F.col("y_j") - F.col("y_i")
    label = F.when(F.abs(dx) >= F.abs(dy), F.when(dx < 0, -1).otherwise(1)).when(dy < 0, -2).otherwise(2)
    return edges.select("i", "j").distinct().join(at("i"), "i").join(at("j"), "j").select("i", "j", label.alias("label"))


def write_cluster(cells: DataFrame, edges: DataFrame, steps: DataFrame, path: str, parts: int = 8) -> None:
    """cells (cell, c_x, c_y and any of area, volume), edges (i, j, label of SIDES) and steps (cell, dx, dy, dt) as `parts` text files in a folder. Steps of cells
    that are not in `cells` are left out. Numbers are written so that they read back equal; a null field is not written."""
    cells = stored(cells, "cells")
    counts = cells.select("cell").join(steps.groupBy("cell").agg(F.count("*").alias("_k")), "cell", "left").fillna(0, ["_k"])
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v.cast("string"))
    fields = [line(name, F.col(c)) for name, c in FIELDS.items() if c != "k" and c in cells.columns]
    heads = cells.join(counts, "cell").select("cell", F.posexplode(F.array(line("ZONE", F.col("cell") + 1), line("NUMBER_OF_TRANSLOCATIONS", F.col("_k")), *fields)).alias("at", "value"))
    near = edges.groupBy(F.col("i").alias("cell")).agg(*(F.sort_array(F.collect_list(F.when(F.col("label") == v, F.col("j") + 1))).alias(s) for s, v in SIDES.items()))
    near = cells.select("cell").join(near, "cell", "left")
    listed = [F.array(line(f"NUMBER_OF_{s}_NEIGHBOURS", F.coalesce(F.size(s), F.lit(0))), F.when(F.size(s) > 0, line(f"{s}_NEIGHBOURS", F.array_join(s, "\t")))) for s in SIDES]
    sides = near.select("cell", F.posexplode(F.concat(*listed, F.array(F.lit("DX\tDY\tDT")))).alias("at", "value")).withColumn("at", F.col("at") + 100)
    # Steps are ordered by their lines, so that a zone's many steps can be ranged over several parts.
    own = steps.join(cells.select("cell"), "cell", "left_semi").select("cell", F.lit(1000).alias("at"), F.concat_ws("\t", *(F.col(c).cast("string") for c in ("dx", "dy", "dt"))).alias("value"))
    every = heads.unionByName(sides).unionByName(own).where("value IS NOT NULL")
    every.repartitionByRange(parts, "cell", "at", "value").sortWithinPartitions("cell", "at", "value").select("value").write.text(path)


def read_vmesh(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(maps, header): a row per zone, with the columns that the file's table names (MAP_COLUMNS, or the file's own names), NA as null; and the lines above the table."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("value")).where("value <> ''")
    top = [r.value for r in lines.where(~F.col("value").rlike(r"^-?\d+\t")).collect()]
    names = next(x for x in top if x.startswith("Zone ID")).split("\t")
    parts = F.split("value", "\t")
    rows = lines.where(F.col("value").rlike(r"^-?\d+\t")).select(*(F.try_element_at(parts, F.lit(n + 1)).try_cast("double").alias(MAP_COLUMNS.get(name, name)) for n, name in enumerate(names)))
    maps = rows.withColumns({"cell": (F.col("cell") - 1).cast("int"), **({"k": F.col("k").cast("long")} if "k" in rows.columns else {})})
    return maps, dict(x.split(": ", 1) for x in top if ": " in x)


def write_vmesh(maps: DataFrame, path: str, header: dict[str, object], parts: int = 1) -> None:
    """maps (cell, k, c_x, c_y and any other of MAP_COLUMNS) below the lines of `header`, in order of cells, as `parts` text files in a folder, the first with the
    header; nulls and what is no number as NA."""
    names = {name: c for name, c in MAP_COLUMNS.items() if c in maps.columns}
    shown = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("string")), F.lit("NA"))
    rows = maps.select((F.col("cell") + 1).cast("long").alias("at"), F.concat_ws("\t", *((F.col(c) + 1).cast("string") if c == "cell" else shown(c) for c in names.values())).alias("value"))
    top = [*(f"{k}: {v}" for k, v in header.items()), "", "\t".join(names)]
    heads = maps.sparkSession.createDataFrame([(n - len(top), x) for n, x in enumerate(top)], "at long, value string")
    heads.unionByName(rows).repartitionByRange(parts, "at").sortWithinPartitions("at").select("value").write.text(path)
