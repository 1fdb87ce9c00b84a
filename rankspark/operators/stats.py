"""Paired statistics: 2x2 tables, exact McNemar, deltas, bootstrap intervals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .order import small


def paired(metrics: DataFrame, a: str, b: str, keys: list[str], values: list[str]) -> DataFrame:
    """One row per item that both methods have: value_a, value_b. One shuffle instead of a self-join."""
    aggs = [F.max(F.when(F.col("method") == m, F.col(v))).alias(f"{v}_{s}") for v in values for m, s in ((a, "a"), (b, "b"))]
    both = F.countDistinct(F.when(F.col("method").isin(a, b), F.col("method")))
    return metrics.filter(F.col("method").isin(a, b)).groupBy(*keys).agg(*aggs, both.alias("have")).filter("have = 2").drop("have")


def table_2x2(pairs: DataFrame, a: str = "detected_a", b: str = "detected_b") -> DataFrame:
    x, y = F.col(a) > 0.5, F.col(b) > 0.5
    t = pairs.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))
    return t.withColumn("discordant", F.col("a_only") + F.col("b_only"))


def mcnemar(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", F.round(S.mcnemar_exact(F.col("a_only"), F.col("b_only")), 9))


def hash_draws(n_samples: int, pairs: DataFrame, seed: int) -> DataFrame:
    """Bootstrap multiset drawn by md5: row position pos of sample s is md5(seed:s:pos) mod n, the same in any engine.

    pairs: pos 0..n-1, n and values. Returns the drawn rows with sample; samples are dealt out over all cores, so that the pairs,
    which may come from one task, don't make all draws there.
    """
    pairs = small(pairs)
    draws = pairs.sparkSession.range(n_samples).select(F.col("id").alias("sample")).crossJoin(pairs.select("pos", "n"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col("pos").cast("string")))
    draws = draws.select("sample", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n")).alias("pos"))
    return draws.join(pairs.drop("n"), "pos")


def percentile_interval(samples: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return samples.agg(F.round(F.percentile(value, lo), 6).alias("lo"), F.round(F.percentile(value, hi), 6).alias("hi"), F.count(F.lit(1)).alias("n_samples"))


def mersenne_draws(spark, n: int, n_samples: int, seed: int) -> DataFrame:
    """(sample, pos, times): the paired bootstrap of one Mersenne Twister shared by all contrasts.

    One generator must run in order, so one task makes the draws; they are n_samples x n integers whatever the data's size.
    """
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        for _ in batches:
            rng = random.Random(seed)
            for first in range(0, n_samples, 200):
                rows = [(s, p, c) for s in range(first, min(first + 200, n_samples)) for p, c in Counter(rng.randrange(n) for _ in range(n)).items()]
                yield pd.DataFrame(rows, columns=["sample", "pos", "times"])

    return spark.range(1, numPartitions=1).mapInPandas(draw, "sample long, pos long, times long")


def bootstrap_delta(draws: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference a-b of every sample: (sample, delta)."""
    drawn = draws.join(pairs, "pos")
    return drawn.groupBy("sample").agg((F.sum((F.col(a) - F.col(b)) * F.col("times")) / F.sum("times")).alias("delta"))
