"""Prediction rows: one for every ranked class of every method, with the cache entry that its score came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .order import small

# The columns of a prediction row and its version.
SCHEMA_VERSION = "predictions-v1"
CORE = ("schema_version", "qualified_id", "example_id", "split", "method", "test_class", "rank", "score", "score_applicable", "bm25_rank", "source_missing", "experiment_commit", "run_id", "ranking_path")
USAGE = ("cache_key", "provider", "model_id", "observed_model_id", "prompt_version", "usage", "latency_ms", "price_basis", "provider_request_id")
COLUMNS = CORE + USAGE
OUTSIDE = "outside_bm25_shortlist"
BUCKETS = 64  # of an example's classes


def prediction_rows(ranked: DataFrame, cache: DataFrame | None, *, method: str, qualified: Column, slug: Column, commit: str, run_id: str, path: Column, scored: Column | None = None) -> DataFrame:
    """The 23 columns, shortlist_member and inapplicable_reason.

    ranked: test_class, rank, score, bm25_rank, source_missing, and cache_key where a cache is given. scored marks the
    shortlist of a reranking; without it every row has a score that applies. Rows without an entry have null usage columns.
    """
    within = F.lit(True) if scored is None else scored
    fixed = {
        "schema_version": F.lit(SCHEMA_VERSION), "qualified_id": qualified, "example_id": slug, "split": F.lit("evaluation"), "method": F.lit(method), "test_class": F.col("test_class"), "rank": F.col("rank").cast("int"),
        "score": F.when(within, F.col("score")), "score_applicable": within, "bm25_rank": F.col("bm25_rank").cast("int"), "source_missing": F.col("source_missing"), "experiment_commit": F.lit(commit), "run_id": F.lit(run_id), "ranking_path": path,
    }
    more = [F.when(within, F.lit(True)).otherwise(False).alias("shortlist_member") if scored is not None else F.lit(None).cast("boolean").alias("shortlist_member"), F.when(~within, F.lit(OUTSIDE)).alias("inapplicable_reason")]
    blank = lambda df, kinds: df.withColumns({c: F.lit(None).cast(kinds[c]) for c in USAGE})
    if cache is None:
        rows = blank(ranked, {c: "double" if c == "latency_ms" else "string" for c in USAGE})
    else:  # rows without a key, however many, would all be one group of a join
        entries = cache.select(*USAGE)
        rows = ranked.filter("cache_key is not null").join(entries, "cache_key", "left").unionByName(blank(ranked.filter("cache_key is null"), dict(entries.dtypes)))
    return rows.select(*[fixed[c].alias(c) for c in CORE], *USAGE, *more)


def prints(rows: DataFrame, by: list[str], sign: int) -> DataFrame:
    """(by, bucket, sums): the rows' number and the sums of two hashes of their classes, 128 bits in four parts that don't overflow, by bucket of the hash."""
    one, two = F.xxhash64("test_class"), F.xxhash64(F.lit(7), "test_class")
    parts = [x for h in (one, two) for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1)))]
    return rows.groupBy(*by, bucket().alias("bucket")).agg((F.count(F.lit(1)) * sign).alias("s0"), *[(F.sum(x) * sign).alias(f"s{i + 1}") for i, x in enumerate(parts)])


def bucket() -> Column:
    return F.pmod(F.shiftright(F.xxhash64("test_class"), 7), F.lit(BUCKETS))


def place(at: Column) -> Column:
    """One number for a method, an example and a bucket; where two share it, more rows than need be are grouped."""
    return F.xxhash64("method", "qualified_id", at)


def prediction_violations(rows: DataFrame, inventory: DataFrame, cache: DataFrame | None = None, listed_once: bool = False) -> DataFrame:
    """(rule, method, qualified_id, test_class): keys twice, classes lost or unknown, scores where none applies or missing where one does, scores that differ from the cache.

    inventory: qualified_id, test_class. listed_once: it is known to hold no class of an example twice. Then rows whose number
    and sums of hashes are those of the inventory are it, and only the buckets where these differ are grouped by key.
    """
    keys = ["method", "qualified_id", "test_class"]
    pick = lambda df, rule: df.select(F.lit(rule).alias("rule"), *keys)
    own = rows.select(*keys)
    # one grouping of the rows beside what they should be: a method's rows of an example against its inventory
    if listed_once:
        held = cut(prints(own, ["method", "qualified_id"], 1))
        ranked = cut(held.select("method", "qualified_id").distinct())
        due = prints(inventory, ["qualified_id"], -1).join(small(ranked), "qualified_id")
        sums = [f"s{i}" for i in range(5)]
        off = held.unionByName(due).groupBy("method", "qualified_id", "bucket").agg(*[F.sum(x).alias(x) for x in sums]).filter(" or ".join(f"{x} <> 0" for x in sums))
        off = small(cut(off.select(place(F.col("bucket")).alias("place")).distinct()))
        there = lambda df: df.withColumn("place", place(bucket())).join(off, "place", "left_semi").drop("place")
    else:
        ranked = cut(own.select("method", "qualified_id").distinct())
        there = lambda df: df
    want = there(inventory.select("qualified_id", "test_class").join(small(ranked), "qualified_id").select(*keys))
    both = there(own).select(*keys, F.lit(1).alias("seen"), F.lit(0).alias("due")).unionByName(want.select(*keys, F.lit(0).alias("seen"), F.lit(1).alias("due")))
    n = both.groupBy(*keys).agg(F.sum("seen").alias("seen"), F.sum("due").alias("due")).filter("seen <> 1 or due <> 1")
    times = lambda rule, count, when: F.when(when, F.array_repeat(F.lit(rule), count.cast("int"))).otherwise(F.array())
    seen, due = F.col("seen"), F.col("due")
    broken = F.concat(times("duplicate key", F.lit(1), seen > 1), times("missing class", due, seen == 0), times("unknown class", seen, due == 0))
    out = n.select(F.explode(broken).alias("rule"), *keys)
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    applies = F.col("score_applicable")
    rules = {"no score": applies & ~F.coalesce(finite, F.lit(False)), "score outside the shortlist": ~applies & F.col("score").isNotNull(), "no reason": ~applies & (F.coalesce("inapplicable_reason", F.lit("")) != OUTSIDE)}
    wrong = rows.filter(reduce(Column.__or__, rules.values()))  # before arrays are made, of which most rows need none
    each = wrong.select(F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()])).alias("broken"), *keys)
    out = out.unionByName(each.select(F.explode("broken").alias("rule"), *keys))
    if cache is not None:
        j = rows.filter("score_applicable and cache_key is not null").join(cache.select("cache_key", F.col("score").alias("cached")), "cache_key", "left")
        out = out.unionByName(pick(j.filter(~F.coalesce(F.abs(F.col("score") - F.col("cached")) <= 1e-12, F.lit(False))), "score differs from the cache"))
        models = rows.filter("observed_model_id is not null").groupBy("method", "qualified_id").agg(F.countDistinct("observed_model_id").alias("n")).filter("n > 1")
        out = out.unionByName(models.select(F.lit("several observed models").alias("rule"), "method", "qualified_id", F.lit(None).cast("string").alias("test_class")))
    return out
