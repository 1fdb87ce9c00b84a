"""Seeded baselines: Mersenne-Twister permutations and samples for parity, hash orders for scale."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_hash
from ..sources.scratch import cut
from .lexical import MOST_PAIRS
from .order import small


def hash_ranks(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """Adds rank in the seeded hash order of each group."""
    w = Window.partitionBy(*by).orderBy(order_hash(seed, *[F.col(c) for c in [*by, key]]), F.col(key))
    return df.withColumn("rank", F.row_number().over(w).cast("long"))


def hash_first_ranks(docs: DataFrame, positives: DataFrame, seed: int) -> DataFrame:
    """(item, first_rank): rank of each item's first positive (item, doc) in its seeded hash order of all docs (doc).

    Documents ahead are counted as their hashes are made; what a hash begins with is one string an item, what it ends with one a document.
    """
    best = positives.groupBy("item").agg(F.min(F.struct(order_hash(seed, F.col("item"), F.col("doc")).alias("h"), "doc")).alias("b"))
    best = cut(best.select("item", F.concat(F.lit(f"{seed}:"), F.col("item").cast("string")).alias("head"), F.col("b.h").alias("h"), F.col("b.doc").alias("first")))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * best.count() // MOST_PAIRS))
    each = docs.select("doc").repartition(tasks).select("doc", F.concat(F.lit(":"), F.col("doc").cast("string")).alias("tail"))  # ids are short, their hashes many
    near = each.join(small(best), F.md5(F.concat("head", "tail")) <= F.col("h"))  # equal hashes are nearly always the positive itself
    before = (F.col("doc") < F.col("first")) | (F.md5(F.concat("head", "tail")) < F.col("h"))
    ahead = near.groupBy("item").agg(F.count_if(before).alias("ahead"))
    return best.select("item").join(ahead, "item", "left").select("item", (F.coalesce("ahead", F.lit(0)) + 1).alias("first_rank"))


def stratified_hash_sample(df: DataFrame, stratum: str, key: str, seed: int, size: int, development: int) -> DataFrame:
    """`size` rows a stratum in seeded hash order, the first `development` of them for development."""
    w = Window.partitionBy(stratum).orderBy(order_hash(seed, F.col(stratum), F.col(key)), F.col(key).cast("string"))
    picked = df.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= size)
    return picked.withColumn("split", F.when(F.col("position") <= development, "development").otherwise("evaluation"))


def mersenne_sample(df: DataFrame, stratum: str, key: str, order: list[str], seed: int, size: int, development: int) -> DataFrame:
    """One generator over the strata in a fixed order; ids sorted as strings before sampling.

    The population is an ID list of a catalogue, so one task holds it; big tables use stratified_hash_sample.
    """
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        rng, out = random.Random(seed), []
        for s in order:
            ids = sorted(pdf.loc[pdf[stratum] == s, key].astype(str))
            for i, x in enumerate(rng.sample(ids, min(size, len(ids)))):
                out.append((s, x, i, "development" if i < development else "evaluation"))
        return pd.DataFrame(out, columns=["stratum", "id", "position", "split"])

    return df.select(stratum, key, F.lit(0).alias("all_strata")).groupBy("all_strata").applyInPandas(pick, "stratum string, id string, position long, split string")


def permutation_metrics(df: DataFrame, by: str, key: str, positive: str, base_seed: int, count: int) -> DataFrame:
    """Means over `count` Mersenne-Twister permutations of each group: mean_rank, rr, nftr, apfd, fdr10.

    A group is one item's inventory (hundreds of classes); seed = base + the item's index column `seed_index`.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import math
        import random

        pdf = pdf.sort_values(key)
        ids, good = list(pdf[key]), set(pdf.loc[pdf[positive], key])
        if not good:
            return pd.DataFrame({by: [], "mean_rank": [], "rr": [], "nftr": [], "apfd": [], "fdr10": []}).astype({by: pdf[by].dtype})
        rng, n, k = random.Random(base_seed + int(pdf["seed_index"].iloc[0])), len(ids), max(1, math.ceil(0.10 * len(ids)))
        sums = [0.0] * 5
        for _ in range(count):
            order = ids[:]
            rng.shuffle(order)
            r = next(i for i, x in enumerate(order, 1) if x in good)
            for j, v in enumerate((r, 1 / r, r / n, 1 - r / n + 1 / (2 * n), float(r <= k))):
                sums[j] += v
        return pd.DataFrame([[pdf[by].iloc[0], *(round(x / count, 9) for x in sums)]], columns=[by, "mean_rank", "rr", "nftr", "apfd", "fdr10"])

    kind = dict(df.dtypes)[by]
    return df.groupBy(by).applyInPandas(run, f"{by} {kind}, mean_rank double, rr double, nftr double, apfd double, fdr10 double")


def permutations(df: DataFrame, by: str, key: str, base_seed: int, count: int) -> DataFrame:
    """(by, permutation, sha256): fingerprints of seeded shuffles of each group's sorted ids; ids NUL-joined."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib
        import random

        ids = sorted(pdf[key].astype(str))
        if len(set(ids)) != len(ids):
            raise ValueError("duplicate ids")
        rng, out = random.Random(base_seed + int(pdf["seed_index"].iloc[0])), []
        for i in range(count):
            order = ids[:]
            rng.shuffle(order)
            out.append((pdf[by].iloc[0], i, hashlib.sha256("\0".join(order).encode()).hexdigest()))
        return pd.DataFrame(out, columns=[by, "permutation", "sha256"])

    return df.groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, permutation long, sha256 string")
