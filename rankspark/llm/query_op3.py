"""op3: secrets in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import secrets

NAME = "op3_secret_scan"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
