"""op10: the language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid

NAME = "op10_language_id"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    profiles = langid.learn(docs.filter(~out & F.col("doc_id").isNotNull()), "text", "lang")
    return langid.predict(docs, "text", profiles, [F.col("doc_id"), out.alias("held_out")])
