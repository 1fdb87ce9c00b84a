"""The corpus pipeline: language ID, line dedup, near-duplicate documents, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents. run() writes each stage's rows to the shared folder, reads them again for the next, and deletes what no stage needs
any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rankspark.llm import kernels, langid, line_dedup, mixing, ngram_join, pieces
from rankspark.llm.query_op1 import MODEL

CLEAR_SCORE = 0.4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those clearly of another language than they claim; a missing claim is filled in."""
    profiles = langid.learn(docs.filter(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), "text", "lang")
    said = langid.predict(docs, "text", profiles, [F.col(c) for c in COLUMNS])
    doubtful = F.col("score") < CLEAR_SCORE
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang").isNull() | (F.col("lang") == F.col("lang_pred")) | doubtful)
    return said.filter(known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; documents stay, if need be with an empty text."""
    return _sized(line_dedup.deduplicated(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard 0.8 or more stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the schedule takes them, in the order of its slots."""
    return _sized(mixing.mixed_documents(docs.select(*COLUMNS)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as piece ids. Copies of a document have segmentations of their own, told apart by their rows' places in the files that hold the mix."""
    try:
        docs = docs.select(*COLUMNS, F.col("_metadata.row_index").alias("row_index"))
    except AnalysisException:  # rows that come from no file have no place
        docs = docs.select(*COLUMNS).withColumn("row_index", F.lit(None).cast("long"))
    return pieces.encoded(docs, MODEL, copy=F.col("row_index")).drop("row_index")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # language profiles, template trees and pieces have no SQL form; tests run the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        mark, before = kernels.cut_mark(), docs
        docs = kernels.cut(stage(spark, docs, sf_dir))
        kernels.drop_cut(*[c for c in kernels.cuts_since(mark) if c is not docs], before)  # the stage's result is written
    return STAGES[-1][1](spark, docs, sf_dir)
