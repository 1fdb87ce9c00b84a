"""op1: all documents as pieces, one merge in ten dropped."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import pieces

NAME = "op1_sentencepiece"
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), MODEL, ids=False)
