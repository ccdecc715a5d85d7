"""op4: licenses in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepfield.llm import licenses
from stepfield.llm.common import table


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scans": op4_license_scans}
ORACLE: dict[str, str] = {}
