"""Columns that are named like the operators' own, nulls, very long texts and empty tables, through the pipeline and the URL model."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepfield.llm import nearcopies, q_urls, urls

NAMES = ["_key", "_tk", "_root", "_copies", "_suffix", "_top", "_two", "_found", "_far", "fp", "score", "quality_score", "sequence_id"]


def named(df):
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("none"))) for c in NAMES})


@pytest.fixture
def folder(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    long = " ".join(f"word{i % 1013}" for i in range(300_000))
    odd = [(9001, long, "en", "s", len(long)), (9002, "", "en", "s", 0), (9003, None, None, None, None), (None, "A text without a number, of some length.", "en", None, 40)]
    more = docs.unionByName(spark.createDataFrame([*odd, odd[0], odd[3]], docs.schema))
    named(more).write.parquet(f"{tmp_path}/some/documents.parquet")
    named(more.limit(0)).write.parquet(f"{tmp_path}/none/documents.parquet")
    for table in ("labels", "benchmark"):
        df = spark.read.parquet(f"{sf}/{table}.parquet")
        for to in ("some", "none"):
            df.write.parquet(f"{tmp_path}/{to}/{table}.parquet")
    return tmp_path


def test_pipeline_on_edge_rows(spark, folder, shared):
    docs = spark.read.parquet(f"{folder}/some/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{folder}/some")
        assert out.columns == docs.columns, name
        for r in out.collect():
            own = "none" if r.doc_id is None else str(r.doc_id)
            assert all(r[c] == f"{c} of {own}" for c in NAMES), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    whole = corpus_pipeline.run(spark, f"{folder}/some")
    pieces = whole.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and all(r.n > 0 for r in pieces)


def test_pipeline_on_an_empty_table(spark, folder, shared):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_near_copies_keep_columns(spark, folder, shared):
    docs = spark.read.parquet(f"{folder}/some/documents.parquet")
    kept = nearcopies.keep_one(docs).collect()
    assert sum(r.doc_id == 9001 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 1
    assert all(r._key == f"_key of {'none' if r.doc_id is None else r.doc_id}" for r in kept)


def test_url_model_keeps_columns(spark, sf, shared):
    pages = named(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").limit(80))
    model = urls.fit(pages.select("url", F.col("url").rlike("|".join(q_urls.UNWANTED)).cast("int").alias("label")))
    out = urls.add_probability(pages, model)
    assert out.columns == [*pages.columns, "block_probability"] and out.count() == pages.count() > 40
    assert all(r[c] == f"{c} of {r.page_id}" for r in out.collect() for c in NAMES)
