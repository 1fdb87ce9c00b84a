"""Cohort filters, recall, miss classes, decisions, headline marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclude(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """The headline cohort: listed items go for every method."""
    return df.join(excluded.select(*keys).distinct(), keys, "left_anti")


def grouping_slices(metrics: DataFrame, dims: tuple[str, str], aggs: list[Column]) -> DataFrame:
    """Per method overall and per (method, slice) in one pass; the overall rows have a null slice."""
    method, part = dims
    m, p = F.col(method), F.col(part)
    return metrics.groupingSets([[m], [m, p]], m, p).agg(*aggs)


def candidate_recall(hits: DataFrame, hit: str) -> DataFrame:
    return hits.agg(F.round(F.avg(F.col(hit).cast("double")), 6).alias("recall"), F.count(F.lit(1)).alias("n_items"))


def classify_misses(df: DataFrame, detected: Column, in_shortlist: Column, item: str) -> DataFrame:
    """Exhaustive classes with their counts and sorted items."""
    label = F.when(detected, "detected").when(in_shortlist, "reranker_miss").otherwise("candidate_generation_miss")
    return df.withColumn("class", label).groupBy("class").agg(F.count(F.lit(1)).alias("n_items"), F.min(item).alias("first_item"), F.max(item).alias("last_item"))


def practical_success(df: DataFrame, fdr: Column, baseline: Column, peer: Column, cost_ratio: Column) -> DataFrame:
    """Alternative 1: 5 points ahead of the baseline; alternative 2: within 2 points of the peer at 30 % of its cost. The first wins."""
    one = fdr >= baseline + 0.05
    two = (F.abs(fdr - peer) <= 0.02) & (cost_ratio <= 0.30)
    return df.withColumn("success", one | two).withColumn("via", F.when(one, "alternative_1").when(two, "alternative_2").otherwise("none"))


def mark_best(df: DataFrame, value: str, lower_better: bool = False) -> DataFrame:
    """Marks every row within 1e-12 of the best."""
    w = Window.partitionBy(F.lit(0))  # rows are methods
    best = (F.min if lower_better else F.max)(value).over(w)
    return df.withColumn("best", F.abs(F.col(value) - best) < 1e-12)


def rank_deltas(pairs: DataFrame, a: str, b: str, item: str, top: int) -> DataFrame:
    """Top gains and losses of rank b - rank a; an item among the gains doesn't return among the losses."""
    d = pairs.withColumn("delta", F.col(a) - F.col(b)).withColumn("sign", F.signum(F.col(a) - F.col(b)).cast("int"))
    gains = d.orderBy(F.col("delta").desc(), F.col(item)).limit(top).withColumn("arm", F.lit("gain"))
    losses = d.join(gains.select(item), item, "left_anti").orderBy(F.col("delta").asc(), F.col(item)).limit(top).withColumn("arm", F.lit("loss"))
    return gains.unionByName(losses)
