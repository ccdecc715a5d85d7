"""Location tables: n (trajectory), row_id (unique), t, x, y[, z][, source]."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as trajectories: a user's values and props.k over time."""
    seconds = F.expr("cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18,6))").cast("double")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("n"), F.col("event_id").alias("row_id"), seconds.alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("source")
    )


def unit_time(df: DataFrame) -> DataFrame:
    """t replaced by the row's number in its trajectory, from 0: a constant time step."""
    w = Window.partitionBy("n").orderBy("t", "row_id")
    return df.withColumn("t", (F.row_number().over(w) - 1).cast("double"))


def has_header(line: str) -> bool:
    """Whether a first line names columns: it has a letter other than the e of numbers."""
    return bool(re.search(r"[A-Za-df-zDF-Z]", re.sub(r"(?i)\b(nan|inf)\b", "", line)))


def read_xyt(spark: SparkSession, paths: str | list[str], columns: Iterable[str] = ("n", "x", "y", "t"), header: bool | None = None, reset_origin: bool = False) -> DataFrame:
    """White-space separated text files. header: False skips the first line of each file, True takes names from it, None looks.

    Ids of several files are kept apart by adding, file by file in order of path, the largest id so far. A column without a
    single value is an error. row_id is unique and follows the order of lines within a file's split."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row_id"))
    first = lines.where("block = 0").groupBy("source").agg(F.min_by("value", "row_id").alias("value"), F.min("row_id").alias("row_id"))
    heads = {r.source: r for r in first.collect()}
    named = {s: header if header is not None else has_header(r.value) for s, r in heads.items()}
    if header is True:
        columns = next(iter(heads.values())).value.split()
    columns = list(columns)
    skipped = [r.row_id for s, r in heads.items() if header is False or named[s]]
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").where(~F.col("row_id").isin(skipped) if skipped else F.lit(True))
    df = rows.select("row_id", "source", *(F.try_element_at(parts, F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(columns)))
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    if empty := [c for c in columns if counts[c] == 0]:
        raise ValueError(f"columns without values: {empty}")
    if "n" in columns:
        df = df.withColumn("n", F.col("n").cast("long"))
        top = {r.source: r.m for r in df.groupBy("source").agg(F.max("n").alias("m")).collect()}
        offset, total = F.lit(0), 0
        for s in sorted(top):
            offset = F.when(F.col("source") == s, F.lit(total)).otherwise(offset)
            total += top[s] or 0
        df = df.withColumn("n", F.col("n") + offset)
        tied = df.groupBy("source", "n", "t").count().where("count > 1").limit(1).collect() if "t" in columns else []
        if tied:
            raise ValueError(f"several locations of trajectory {tied[0].n} at time {tied[0].t}")
    return move_to_origin(df, [c for c in columns if c not in ("n", "t")]) if reset_origin else df


def move_to_origin(df: DataFrame, columns: Iterable[str], per_source: bool = False) -> DataFrame:
    """Columns minus their minima over the table, or over each source."""
    columns = list(columns)
    if per_source:
        w = Window.partitionBy("source")
        return df.withColumns({c: F.col(c) - F.min(c).over(w) for c in columns})
    low = df.agg(*(F.min(c).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c) - F.lit(low[c]) for c in columns})


def bounds(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row per column: its name, minimum and maximum."""
    columns = list(columns)
    one = df.agg(*(F.min(c).cast("double").alias(f"{c}_min") for c in columns), *(F.max(c).cast("double").alias(f"{c}_max") for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"{c}_min").alias("low"), F.col(f"{c}_max").alias("high")) for c in columns))).alias("b")).select("b.*")


def by_source(df: DataFrame, keep) -> DataFrame:
    """Rows of one source, of any of a collection, or of those for which a column function holds."""
    if callable(keep):
        chosen: Column = keep(F.col("source"))
    else:
        chosen = F.col("source") == keep if isinstance(keep, str) else F.col("source").isin(*keep)
    return df.where(chosen)


def single_precision(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def scaled_frames(df: DataFrame, dt: float, scale: float = 1.0, coords: Iterable[str] = ("x", "y")) -> DataFrame:
    """Frame numbers to times, pixels to lengths."""
    return df.withColumns({"t": F.col("t") * dt} | {c: F.col(c) * scale for c in coords})


def write_ascii(df: DataFrame, path: str, columns: Iterable[str], header: bool = True) -> None:
    df.select(*columns).write.option("sep", "\t").option("header", header).csv(path)


def write_roi(boxes: DataFrame, path: str) -> None:
    """Regions of interest as the tab-separated bounds that read_roi reads."""
    write_ascii(boxes, path, ["x_min", "x_max", "y_min", "y_max"])


def read_roi(spark: SparkSession, path: str, size: float | None = None, label: str = "roi") -> DataFrame:
    """Regions of interest from tab-separated text: centres (x, y) with a side length, or bounds (x_min, x_max, y_min, y_max)."""
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    rows = rows.withColumns({"label": F.lit(label), "idx": F.monotonically_increasing_id()})
    if size is None:
        return rows.select("label", "idx", "x_min", "x_max", "y_min", "y_max")
    return rows.select("label", "idx", *(e.alias(a) for c in ("x", "y") for e, a in ((F.col(c) - size / 2, f"{c}_min"), (F.col(c) + size / 2, f"{c}_max"))))
