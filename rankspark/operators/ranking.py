"""Ranks, shortlists, reranking and their checks. Ranks are unique: 1..N by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import SHORTLIST_CAP


def rank(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def rank_by_score(df: DataFrame, by: list[str], score: str = "score", key: str = "doc") -> DataFrame:
    """Score descending, key ascending."""
    return rank(df, by, F.col(score).desc(), F.col(key).asc())


def shortlist(ranked: DataFrame, by: list[str], cap: int = SHORTLIST_CAP) -> DataFrame:
    """The exact prefix of min(cap, N)."""
    return ranked.filter(F.col("rank") <= cap)


def rerank(base: DataFrame, scores: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """First k rows of each ranking by (external score desc, base rank); the rest keeps its base order.

    base: by, key, base_rank from 1 on without gaps; scores: by, key, ext_score. Tail rows carry a null score, and keep their
    ranks, so that only heads are joined and sorted.
    """
    head = rank(base.filter(F.col("base_rank") <= k).join(scores, [*by, key], "left"), by, F.col("ext_score").desc_nulls_last(), F.col("base_rank").asc())
    columns = [*[c for c in base.columns if c not in by and c != key], *[c for c in scores.columns if c not in base.columns and c != "ext_score"]]
    kind = scores.schema["ext_score"].dataType
    tail = base.filter(F.col("base_rank") > k).withColumns({"ext_score": F.lit(None).cast(kind), "scored": F.lit(False), "rank": F.col("base_rank").cast("long")})
    return head.withColumn("scored", F.lit(True)).unionByName(tail, allowMissingColumns=True).select(*by, key, *columns, "ext_score", "scored", "rank")


def rerank_violations(base: DataFrame, scores: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """Missing, extra and out-of-range scores: (rule, by, key). Empty for a valid input."""
    head = base.filter(F.col("base_rank") <= k)
    cols = [*by, key]
    missing = head.join(scores, cols, "left_anti").select(F.lit("missing").alias("rule"), *cols)
    extra = scores.join(head, cols, "left_anti").select(F.lit("extra").alias("rule"), *cols)
    score = F.col("ext_score")
    off = scores.filter(score.isNull() | F.isnan(score) | (score < 0) | (score > 1)).select(F.lit("range").alias("rule"), *cols)
    return missing.unionByName(extra).unionByName(off)


def permutation_violations(ranked: DataFrame, inventory: DataFrame, by: list[str], key: str) -> DataFrame:
    """Ranks that aren't 1..N once each, and ids that are repeated, missing or unknown. Empty for a valid ranking."""
    cols = [*by, key]
    both = ranked.select(*cols, F.lit(1).alias("n"), F.lit(False).alias("known")).unionByName(inventory.select(*cols, F.lit(0).alias("n"), F.lit(True).alias("known")))
    ids = both.groupBy(*cols).agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    rule = F.when(F.col("n") == 0, "missing").when(~F.col("known"), "unknown").when(F.col("n") > 1, "repeated")
    ids = ids.select(rule.alias("rule"), *cols).filter("rule is not null")
    r = F.col("rank")  # different ranks are counted in bitmaps of 32,768 ranks
    parts = ranked.groupBy(*by, F.bitmap_bucket_number(r).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(r).alias("lo"), F.max(r).alias("hi"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(r))).alias("d"))
    span = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("d").alias("d"))
    ranks = span.filter("lo <> 1 or hi <> n or d <> n").select(F.lit("ranks").alias("rule"), *by, F.lit(None).cast(ranked.schema[key].dataType).alias(key))
    return ids.unionByName(ranks)


def prefix_violations(candidates: DataFrame, ranked: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """Rows by which a stored shortlist (by, key, rank) differs from the first k of its ranking."""
    cols = [*by, key, "rank"]
    want = ranked.filter(F.col("rank") <= k).select(*cols)
    return candidates.select(*cols).exceptAll(want).withColumn("rule", F.lit("extra")).unionByName(want.exceptAll(candidates.select(*cols)).withColumn("rule", F.lit("missing")))


def shortlist_digest(short: DataFrame, by: list[str], key: str) -> DataFrame:
    """SHA-256 of each shortlist's ids in rank order, each ended by a newline. A shortlist is bounded by its cap."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("id")))), lambda s: s["id"])
    return short.groupBy(*by).agg(F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256).alias("sha256"), F.count(F.lit(1)).alias("k"))


def ranking_ids(ranked_ids: Column, ranking: Column) -> Column:
    """Flat ids if present, else those of the nested ranking."""
    return F.coalesce(ranked_ids, F.transform(ranking, lambda r: r["test_class"]))
