"""Per-item metrics of first positive ranks, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import order


def budget_grid(df: DataFrame, budgets: tuple[float, ...] = S.BUDGETS) -> DataFrame:
    """One row per input row and budget: adds budget."""
    return df.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))


def item_metrics(ranks: DataFrame) -> DataFrame:
    """Adds rr, nftr, apfd to (…, first_rank, n). Null ranks (no ranking) keep null metrics."""
    r, n = F.col("first_rank"), F.col("n")
    return ranks.withColumns({"rr": S.reciprocal_rank(r), "nftr": S.normalized_rank(r, n), "apfd": S.apfd(r, n), "available": r.isNotNull()})


def detection(ranks: DataFrame) -> DataFrame:
    """(…, budget, k, detected 0..1) for every budget."""
    grid = budget_grid(ranks).withColumn("k", S.budget_k(F.col("budget"), F.col("n")))
    return grid.withColumn("detected", (F.col("first_rank") <= F.col("k")).cast("double"))


def detection_rate(ranks: DataFrame, by: list[str]) -> DataFrame:
    return detection(ranks).groupBy(*by, "budget").agg(F.round(F.avg("detected"), 6).alias("fdr"), F.count("detected").alias("n_items"))


def summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*summary_columns())


def summary_columns() -> list:
    return [F.count("first_rank").alias("n_items"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("nftr"), 6).alias("mean_nftr"), F.round(F.median("nftr"), 6).alias("median_nftr"), F.round(F.avg("apfd"), 6).alias("mean_apfd")]


def impute_worst(ranks: DataFrame) -> DataFrame:
    """Missing rankings count as the worst rank N; they detect nothing, not even at the full budget."""
    missing = F.col("first_rank").isNull()
    filled = ranks.withColumn("imputed", missing).withColumn("first_rank", F.coalesce("first_rank", "n"))
    return item_metrics(filled).withColumn("detected_10", F.when(F.col("imputed"), 0.0).otherwise((F.col("first_rank") <= S.budget_k(F.lit(0.10), F.col("n"))).cast("double")))


def empirical_cdf(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sorted value i of n gets i/n; ties keep separate steps."""
    placed = order.ranked(values.select(*by, value), by, value, name="i", size="_n")
    return placed.select(*by, "i", F.round(value, 6).alias("value"), F.round(F.col("i") / F.col("_n"), 6).alias("p"))


def grid_cdf(values: DataFrame, by: list[str], value: str, steps: int = 10) -> DataFrame:
    """Share of values at most y, for the even grid of `steps` + 1 points y in [0, 1].

    Each value adds itself to one grid cell; a running sum over at most steps+1 rows then replaces the grid join.
    """
    cell = F.greatest(F.lit(0), F.ceil((F.col(value) - 1e-15) * steps)).cast("long")
    counts = values.groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    grid = counts.select(*by).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))))
    w = Window.partitionBy(*by)
    filled = grid.join(counts, [*by, "cell"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    run = F.sum("c").over(w.orderBy("cell"))
    return filled.select(*by, F.round(F.col("cell") / steps, 6).alias("y"), F.round(run / F.sum("c").over(w), 6).alias("p"))


def cohort_summary(metrics: DataFrame, by: list[str], costs: DataFrame | None = None, latency: DataFrame | None = None) -> DataFrame:
    """One row a method: denominator, detection rate at every budget, mean reciprocal rank, APFD, mean and median normalised rank, cost an item, latency.

    metrics: first_rank, n and item_metrics() columns; costs: by, usd (the whole cohort's, divided by its size even where an
    item has none); latency: by, mean_ms, p50_ms, p95_ms.
    """
    rate = lambda b: F.round(F.avg((F.col("first_rank") <= S.budget_k(F.lit(b), F.col("n"))).cast("double")), 6).alias(f"fdr_{round(100 * b)}")
    out = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("denominator"), *[rate(b) for b in S.BUDGETS], F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("apfd"), 6).alias("mean_apfd"), F.round(F.avg("nftr"), 6).alias("mean_nftr"), F.round(F.median("nftr"), 6).alias("median_nftr"))
    if costs is not None:
        out = out.join(costs, by, "left").withColumn("usd_per_item", F.round(F.col("usd") / F.col("denominator"), 6)).drop("usd")
    return out if latency is None else out.join(latency.select(*by, "mean_ms", "p50_ms", "p95_ms"), by, "left")


WIDE = (  # fixed values: the columns of the metrics table
    "project", "bug_id", "split", "method", "num_test_classes", "num_trigger_classes", "first_trigger_rank", "reciprocal_rank", "normalized_first_trigger_rank", "apfd",
    "detected_at_1pct", "detected_at_2pct", "detected_at_5pct", "detected_at_10pct", "detected_at_20pct", "detected_at_50pct", "detected_at_100pct", "candidate_trigger_in_top200",
    "reranker_input_tokens", "reranker_output_tokens", "reranker_cost_usd", "reranker_wall_ms", "patch_truncated", "missing_test_source_count", "available", "experiment_commit", "run_id", "qualified_id",
)


def wide_metrics(metrics: DataFrame, costs: DataFrame, free: tuple[str, ...], commit: str, run_id: str) -> DataFrame:
    """The metrics table, one row for each bug and method, kept where a ranking is missing.

    metrics: qualified_id, method, first_rank, n, positives, in_shortlist, patch_truncated, source_missing; costs: qualified_id,
    method, input_tokens, output_tokens, usd, wall_ms. Methods in `free` cost 0 and have no tokens.
    """
    m = item_metrics(metrics).join(costs, ["qualified_id", "method"], "left")
    paid = ~F.col("method").isin(*free)
    hit = {f"detected_at_{round(100 * b)}pct": F.col("first_rank") <= S.budget_k(F.lit(b), F.col("n")) for b in S.BUDGETS}
    columns = {
        "project": F.substring_index("qualified_id", "-", 1), "bug_id": F.substring_index("qualified_id", "-", -1), "split": F.lit("evaluation"), "method": F.col("method"),
        "num_test_classes": F.col("n"), "num_trigger_classes": F.col("positives"), "first_trigger_rank": F.col("first_rank"), "reciprocal_rank": F.round("rr", 9), "normalized_first_trigger_rank": F.round("nftr", 9), "apfd": F.round("apfd", 9), **hit,
        "candidate_trigger_in_top200": F.col("in_shortlist"), "reranker_input_tokens": F.when(paid, F.col("input_tokens")), "reranker_output_tokens": F.when(paid, F.col("output_tokens")),
        "reranker_cost_usd": F.when(paid, F.col("usd")).otherwise(0.0), "reranker_wall_ms": F.when(paid, F.col("wall_ms")), "patch_truncated": F.col("patch_truncated"), "missing_test_source_count": F.col("source_missing"),
        "available": F.col("available"), "experiment_commit": F.lit(commit), "run_id": F.lit(run_id), "qualified_id": F.col("qualified_id"),
    }
    return m.select(*[columns[c].alias(c) for c in WIDE])
