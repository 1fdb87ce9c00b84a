"""All result tables of one evaluation in a fixed order, then the checks across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import metrics, seal, stats
from ..sources.tables import write_csv
from . import contracts
from . import evaluation as E

STEPS = ("metrics", "cohort", "projects", "budget_curve", "nftr_cdf", "quality_cost", "contrast", "checks")


def regenerate(spark: SparkSession, sf_dir: str, out: str) -> dict[str, DataFrame]:
    """Writes every table of STEPS but the checks under `out`, reads them again, and fails with the first rows that disagree."""
    table: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        table[name] = spark.read.parquet(f"{out}/{name}")
        return table[name]

    wide = put("metrics", contracts.wide(spark, sf_dir))
    write_csv(wide, f"{out}/metrics_csv", list(metrics.WIDE))
    wide = wide.filter("available")
    items = metrics.item_metrics(wide.select("qualified_id", "project", "method", F.col("first_trigger_rank").alias("first_rank"), F.col("num_test_classes").alias("n")))
    spent = wide.groupBy("method").agg(F.sum("reranker_cost_usd").alias("usd"))
    cohort = put("cohort", metrics.cohort_summary(items, ["method"], spent))
    put("projects", metrics.cohort_summary(items, ["project", "method"]))
    put("budget_curve", metrics.detection_rate(items, ["method"]))
    put("nftr_cdf", metrics.empirical_cdf(items, ["method"], "nftr"))
    put("quality_cost", cohort.unpivot(["method"], ["fdr_10", "usd_per_item"], "axis", "value"))
    hit = items.withColumn("detected", (F.col("first_rank") <= S.budget_k(F.lit(0.10), F.col("n"))).cast("double"))
    put("contrast", stats.mcnemar(stats.table_2x2(stats.paired(hit, "BM25", "Random", ["qualified_id"], ["detected"]))))
    written = wide.select("method", F.col("qualified_id").alias("item"), F.col("first_trigger_rank").cast("double").alias("first_rank"), F.col("detected_at_10pct").alias("detected"), F.col("reranker_cost_usd").alias("usd"))
    again = E.first_ranks(spark, sf_dir).select("method", F.concat(F.lit("Cli-"), "item").alias("item"), "first_rank")
    summary = cohort.select("method", F.col("fdr_10").alias("fdr"), "usd_per_item")
    table["checks"] = seal.seal({"tables disagree": seal.consistency_violations(written, again, summary, tolerance=1e-6)}, cohort)
    return table
