"""op6: every document scored by a language model of the training documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepfield.llm import lm
from stepfield.llm.common import table


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLE: dict[str, str] = {}
