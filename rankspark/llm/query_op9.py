"""op9: every document's expected grade, learned from the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality

NAME = "op9_quality_classifier"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("doc", "doc_id")
