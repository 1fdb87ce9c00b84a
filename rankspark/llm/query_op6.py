"""op6: every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import urls

NAME = "op6_url_filter"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))  # the contract's words


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules=RULES)
    return out.withColumnRenamed("page", "page_id")
