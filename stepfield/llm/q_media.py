"""op1: every document stored as an image in tar shards and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepfield.llm import media
from stepfield.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = media.store_media(table(spark, sf_dir, "documents"))
    return media.read_payloads(media.read_headers(index)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


QUERIES = {"op1_media_columns": op1_media_columns}
ORACLE: dict[str, str] = {}
