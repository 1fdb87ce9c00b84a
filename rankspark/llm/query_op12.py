"""op12: how toxic every document is, learned from the labels of those whose crc32(doc_id) is not divisible by 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity

NAME = "op12_toxicity"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, [F.col("doc_id"), toxicity.held_out(F.col("doc_id")).alias("held_out")])
