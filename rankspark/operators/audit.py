"""Violation queries: each returns the rows that break a rule, so a sound input gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(rule, keys) for each rule a row breaks; one pass over the data. A rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), *keys)


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) with zero rows kept."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


def reconcile_keys(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: (keys, side)."""
    a, b = expected.select(*keys).distinct().withColumn("e", F.lit(True)), seen.select(*keys).distinct().withColumn("s", F.lit(True))
    both = a.join(b, keys, "full_outer").filter("e is null or s is null")
    return both.select(*keys, F.when(F.col("e").isNull(), "unexpected").otherwise("missing").alias("side"))


def compare_digests(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) over (path, sha256) frames: same, changed, added or removed."""
    j = before.select("path", F.col("sha256").alias("x")).join(after.select("path", F.col("sha256").alias("y")), "path", "full_outer")
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return j.select("path", status.alias("status"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_empty(bad: DataFrame, context: str) -> None:
    """Fails closed with a few of the offending rows."""
    if rows := bad.limit(5).collect():
        raise ValueError(f"{context}: {rows}")


def lifecycle(artifacts: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, state, missing, broken): complete with every artifact there, in error where one that is there breaks its rule, else incomplete.

    artifacts: a column for each name in rules, null where the artifact is not there.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in rules]))
    broken = F.array_compact(F.array(*[F.when(F.col(n).isNotNull() & ~F.coalesce(ok, F.lit(True)), F.lit(n)) for n, ok in rules.items()]))
    state = F.when(F.size("broken") > 0, "error").when(F.size("missing") > 0, "incomplete").otherwise("complete")
    return artifacts.select(*keys, missing.alias("missing"), broken.alias("broken")).withColumn("state", state)


def drift(expected: DataFrame, observed: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """(keys, expected, observed, status): facts of a locked manifest against those of today's source."""
    a = expected.select(*keys, F.struct(*facts).alias("expected"))
    b = observed.select(*keys, F.struct(*facts).alias("observed"))
    status = F.when(F.col("observed").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("observed"), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").withColumn("status", status)


def score_entry_rules(version: str) -> dict[str, Column]:
    """Rules of a cached score: schema_version, status, score, input_tokens, cached_tokens, output_tokens, cache_key, recomputed."""
    count = lambda c: F.col(c).isNull() | (F.col(c) >= 0)
    return {
        "schema version": F.col("schema_version") == version, "status": F.col("status") == "ok", "score": F.col("score").between(0, 1) & ~F.isnan("score"),
        "tokens": count("input_tokens") & count("cached_tokens") & count("output_tokens"), "cached tokens": F.coalesce("cached_tokens", F.lit(0)) <= F.coalesce("input_tokens", F.lit(0)), "key": F.col("cache_key") == F.col("recomputed"),
    }


def embedding_entry_rules(version: str, dimension: int) -> dict[str, Column]:
    """Rules of a cached vector: schema_version, embedding; not zero, all numbers finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return {"schema version": F.col("schema_version") == version, "dimension": F.size("embedding") == dimension, "finite": ~bad, "not zero": F.exists("embedding", lambda x: x != 0)}
