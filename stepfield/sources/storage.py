"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local session (as in tests) takes a temporary one, and any other
    raises: executors don't share theirs."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base or f"file://{tempfile.mkdtemp(prefix='stepfield-')}"


def folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder below the shared one."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df written as Parquet to the shared folder and read again. Unlike a checkpoint it is computed once, and the optimizer carries nothing over from
    the plan before, which in long loops of expressions would grow from round to round."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
