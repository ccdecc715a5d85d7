"""op10: all documents packed into sequences of at most 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stepfield.llm import packing
from stepfield.llm.common import table


def packed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    first = packing.tokenize_and_pack(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    return packing.place(packing.pack(first))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE: dict[str, str] = {}
