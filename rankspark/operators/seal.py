"""Sealed inputs, the raw seal and checks across result tables: libraries of violation queries that must all be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .audit import require_empty
from .order import small


def hash_violations(index: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, path): files that the index lists and that are lost or changed. Both: path, sha256."""
    j = index.select("path", F.col("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("seen")), "path", "left")
    rule = F.when(F.col("seen").isNull(), "lost").when(F.col("seen") != F.col("want"), "changed")
    return j.select(rule.alias("rule"), "path").filter("rule is not null")


def sealed_input_violations(inventory: DataFrame, listing: DataFrame, positives: DataFrame, candidates: DataFrame, rankings: DataFrame, gaps: DataFrame) -> DataFrame:
    """(rule, item, method, id): what keeps a bug's inputs from evaluation.

    inventory and listing: item, position, id, which must agree; positives: item, id; candidates: item, rank, id;
    rankings: method, item, rank, id; gaps: method, item of accepted gaps. Rankings must be permutations of the inventory,
    candidates the prefix of BM25, positives known and not empty, and every method there but for the gaps.
    """
    none = F.lit(None).cast("string")
    row = lambda df, rule, method=none, id_=none: df.select(F.lit(rule).alias("rule"), "item", method.cast("string").alias("method"), id_.cast("string").alias("id"))
    items = inventory.select("item").distinct()
    out = row(inventory.select("item", "position", "id").exceptAll(listing.select("item", "position", "id")), "inventory differs from the listing", id_=F.col("id"))
    out = out.unionByName(row(listing.select("item", "position", "id").exceptAll(inventory.select("item", "position", "id")), "listing differs from the inventory", id_=F.col("id")))
    out = out.unionByName(row(items.join(positives, "item", "left_anti"), "no positives"))
    out = out.unionByName(row(positives.join(inventory, ["item", "id"], "left_anti"), "unknown positive", id_=F.col("id")))
    methods = cut(rankings.select("method").distinct())
    absent = items.crossJoin(small(methods, 1_000)).join(rankings.select("method", "item").distinct(), ["method", "item"], "left_anti").join(gaps, ["method", "item"], "left_anti")  # methods are few
    out = out.unionByName(row(absent, "no ranking", F.col("method"))).unionByName(row(rankings.select("method", "item").distinct().join(gaps, ["method", "item"]), "ranking of an accepted gap", F.col("method")))
    n = inventory.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    span = rankings.groupBy("method", "item").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("rank").alias("d"), F.countDistinct("id").alias("ids"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    out = out.unionByName(row(span.join(n, "item").filter("c <> n or d <> n or ids <> n or lo <> 1 or hi <> n"), "no permutation", F.col("method")))
    out = out.unionByName(row(rankings.join(inventory, ["item", "id"], "left_anti"), "unknown id", F.col("method"), F.col("id")))
    prefix = rankings.filter("method = 'BM25'").select("item", "rank", "id")
    return out.unionByName(row(candidates.select("item", "rank", "id").join(prefix, ["item", "rank", "id"], "left_anti"), "no prefix of BM25", id_=F.col("id")))


def commit_violations(documents: DataFrame, commit: str) -> DataFrame:
    """(rule, path) of documents (path, experiment_commit) of another commit than the sealed one."""
    return documents.filter(~F.coalesce(F.col("experiment_commit") == commit, F.lit(False))).select(F.lit("commit").alias("rule"), "path")


def seal_violations(pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(rule, cache_key): scored pairs without a ledger row, and ledger rows of no pair or of a pair that has one already."""
    lines = ledger.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))
    j = pairs.select("cache_key").distinct().withColumn("pair", F.lit(True)).join(lines, "cache_key", "full_outer")
    rule = F.when(F.col("n").isNull(), "no ledger row").when(F.col("pair").isNull(), "no pair").when(F.col("n") > 1, "several ledger rows")
    return j.select(rule.alias("rule"), "cache_key").filter("rule is not null")


def consistency_violations(metrics: DataFrame, ranks: DataFrame, summary: DataFrame, size: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(rule, method, item): per-bug ranks, rates and costs of the written tables against ones computed again.

    metrics: method, item, first_rank, detected, usd; ranks: method, item, first_rank; summary: method, fdr, usd_per_item.
    Tolerances: ranks 1e-9, rates `tolerance`, costs 1e-4 in sum.
    """
    none = F.lit(None).cast("string")
    row = lambda df, rule, item=none: df.select(F.lit(rule).alias("rule"), "method", item.cast("string").alias("item"))
    out = row(metrics.groupBy("method", "item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate", F.col("item"))
    j = metrics.select("method", "item", "first_rank").join(ranks.select("method", "item", F.col("first_rank").alias("again")), ["method", "item"], "full_outer")
    out = out.unionByName(row(j.filter(~F.coalesce(F.abs(F.col("first_rank") - F.col("again")) <= 1e-9, F.lit(False))), "rank", F.col("item")))
    again = metrics.groupBy("method").agg(F.avg(F.col("detected").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("usd", F.lit(0.0))).alias("usd"))
    s = summary.join(again, "method", "full_outer")
    out = out.unionByName(row(s.filter(~F.coalesce(F.abs(F.col("fdr") - F.col("rate")) <= tolerance, F.lit(False))), "rate"))
    out = out.unionByName(row(s.filter(F.col("usd_per_item").isNotNull() & ~F.coalesce(F.abs(F.col("usd_per_item") * F.col("n") - F.col("usd")) <= 1e-4, F.lit(False))), "cost"))
    return out if size is None else out.unionByName(row(s.filter(F.coalesce("n", F.lit(0)) != size), "cohort size"))


def seal(violations: dict[str, DataFrame], index: DataFrame) -> DataFrame:
    """The hash index, if no check finds a violation; an error with the first rows otherwise."""
    for name, bad in violations.items():
        require_empty(bad, name)
    return index
