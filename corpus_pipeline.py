"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Quality: documents that the classifier rejects go. Near-dedup: one document of each group of copies and near copies stays,
the one of the smallest doc_id; links are verified by the similarity of five-word shingles. Decontamination: documents that hold a benchmark passage go. Secrets: every span found is
replaced by a mark, documents stay (n_chars follows). Packing: what is left becomes sequences of 2048 tokens; the result
has a row per piece. Defined cases: null text is empty, has the quality of an empty text, and packs as one end token; an empty text is a
copy of other empty ones; texts of any length count whole; of repeated rows one stays, and rows of one doc_id and different texts are texts
like others; a null doc_id stays null and loses ties; an empty table gives no rows; further columns are kept up to the last stage,
whatever their names. ORACLE_SQL is None: SQL cannot express the classifier, SimHash or the tokenizer.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.llm import decontaminate, nearcopies, packing, quality, secrets
from stepfield.llm.common import free_name, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    return quality.add_scores(docs, forest, score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.place(packing.pack(packing.tokenize_and_pack(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
