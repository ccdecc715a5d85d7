"""Shared helpers: the scratch folder that all executors see, bounded Arrow batches, written tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch handed to a Python task; long texts would otherwise make batches of gigabytes.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def narrow_batches(spark: SparkSession) -> None:
    """Longer batches, for rows of a few numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")


@cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='stepfield-')}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share. Where that is unset, a
    local session (as in tests) takes a temporary folder, and any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/stepfield/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet to a scratch folder (one folder for each value of `by`) and read again: cuts lineage,
    and survives the loss of executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, compared without case as Spark does."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
