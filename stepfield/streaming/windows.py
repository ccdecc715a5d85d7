"""Structured Streaming forms of the time operators; their batch results define what is right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_counts(stream: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Locations per cell in tumbling or sliding windows; rows later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), "cell").agg(F.count("*").alias("k"), F.avg("x").alias("m_x"), F.avg("y").alias("m_y"))


def sessions(stream: DataFrame, gap: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Trajectories split at gaps: one row per session."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), "n").agg(F.count("*").alias("k"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def cell_statistics(stream: DataFrame, width: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Sufficient statistics of translocations (cell, dx, dy, dt) by window, for the inference in closed form."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "cell").agg(
        F.count("*").alias("k"), F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("s"), F.sum("dx").alias("m_x"), F.sum("dy").alias("m_y"), F.avg("dt").alias("dt"), F.max("dt").alias("dt_max")
    )


def kept(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs an aggregated stream over what its source holds now; each batch's changed rows are written below `path`, under the batch's number, so a batch run
    again after a failure replaces its own. Returns the newest row of each key; nothing of the result passes through the driver."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    newest = spark.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values))
