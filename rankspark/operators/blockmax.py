"""A block-max inverted index: postings in blocks of documents with their largest possible contribution, and a search that skips blocks.

Documents stand in the order of their leading term and length, so that a block of BLOCK documents holds alike ones and its
bounds are close. The index has a row for each block and term: the largest BM25 factor in the block (the contribution without
the term's inverse document frequency) and the block's postings. Files are in block order.

search() adds the bounds of an item's terms by block, which reads no postings; scores the SEEDS blocks of the highest bounds, so
that the k-th score found is a lower bound for the k-th score there is; and then scores the blocks whose bound reaches it. No
document of a skipped block can be among the k best, ties included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..sources.scratch import cut
from . import lexical, order

BLOCK, SEEDS, SLACK = 16, 20, 1e-8  # scores are rounded to 9 digits
POSTINGS, TERMS = "block long, term string, most double, docs array<struct<doc:long,factor:double>>", "term string, df long, idf double"


def build(posted: DataFrame, path: str, block: int = BLOCK) -> None:
    """Writes the index of postings (doc, dl, term, tf) to the folder: postings and terms."""
    docs = lexical.documents_of(posted)
    stats = lexical.corpus_stats(docs)
    real = posted.filter("term <> ''")
    lead = real.groupBy("doc").agg(F.max_by("term", F.struct("tf", "term")).alias("lead"))
    placed = order.numbered(docs.join(lead, "doc", "left"), "lead", "dl", "doc").select("doc", F.floor(F.col("position") / block).alias("block"))
    one = F.broadcast(stats)  # one row
    factor = S.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.lit(1.0))
    rows = real.join(placed, "doc").crossJoin(one).select("block", "term", F.struct(F.col("doc").cast("long").alias("doc"), factor.alias("factor")).alias("p"))
    packed = rows.groupBy("block", "term").agg(F.max("p.factor").alias("most"), F.collect_list("p").alias("docs"))  # `block` documents at most
    packed.repartitionByRange("block").sortWithinPartitions("block", "term").write.mode("overwrite").parquet(f"{path}/postings")
    terms = lexical.document_frequency(posted).crossJoin(one).select("term", "df", S.bm25_idf(F.col("n_docs"), F.col("df")).alias("idf"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, terms) of an index."""
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(TERMS).parquet(f"{path}/terms")


def bounds(index: tuple[DataFrame, DataFrame], terms: DataFrame) -> DataFrame:
    """(item, block, bound): what no document of the block can exceed for the item. Postings themselves aren't read."""
    postings, known = index
    weighted = terms.join(known, "term").select("item", "term", "idf")
    return postings.select("block", "term", "most").join(weighted, "term").groupBy("item", "block").agg(F.sum(F.col("most") * F.col("idf")).alias("bound"))


def scored(index: tuple[DataFrame, DataFrame], terms: DataFrame, wanted: DataFrame, digits: int = 9) -> DataFrame:
    """(item, doc, score) of the documents of the wanted blocks (item, block)."""
    postings, known = index
    asked = wanted.join(terms.join(known, "term").select("item", "term", "idf"), "item")
    found = postings.select("block", "term", "docs").join(asked, ["block", "term"]).select("item", "idf", F.explode("docs").alias("p"))
    return found.groupBy("item", F.col("p.doc").alias("doc")).agg(F.round(F.sum(F.col("idf") * F.col("p.factor")), digits).alias("score"))


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, ranked; a ranked cut, of which every task keeps k rows an item before the shuffle."""
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc")))
    return rows.withColumn("rank", at.cast("long")).filter(F.col("rank") <= k)


def wanted_blocks(index: tuple[DataFrame, DataFrame], terms: DataFrame, k: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(blocks to score, all blocks that hold a term of the item), each (item, block, bound), after the seeds' scores."""
    every = cut(bounds(index, terms))
    top = every.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "block"))).filter(F.col("r") <= seeds)
    first = best(scored(index, terms, top.select("item", "block")), k)
    bar = first.groupBy("item").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("item", "bar")
    kept = every.join(cut(bar), "item", "left").filter(F.col("bar").isNull() | (F.col("bound") + SLACK >= F.col("bar")))
    return cut(kept.drop("bar")), every


def search(index: tuple[DataFrame, DataFrame], terms: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
    """(item, doc, score, rank): the k best documents of each item (item, term), equal to the first k of the full ranking that match."""
    terms = cut(terms)
    kept, _ = wanted_blocks(index, terms, k, seeds)
    return best(scored(index, terms, kept.select("item", "block")), k)
