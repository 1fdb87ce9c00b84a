"""op4: the 20 nearest vectors of every twentieth id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann

NAME = "op4_ann_partitions"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 20)
