"""Rankings and shortlists kept by the content of their inputs: reuse, regeneration, locks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import scoring as S
from ..functions import text as T
from ..sources.scratch import cut

# What decides a token list.
TOKENIZER = {"camel_acronym": T.CAMEL_ACRONYM, "camel_lower_upper": T.CAMEL_LOWER_UPPER, "lower": True, "min_length": 2, "non_alnum": T.NON_ALNUM, "stemming": False, "stop_words": False}


def tokenizer_fingerprint() -> str:
    """SHA-256 of the tokenizer's settings as canonical JSON."""
    return hashlib.sha256(json.dumps(TOKENIZER, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def lexical_inputs(queries: DataFrame, inventory: DataFrame, texts: DataFrame) -> DataFrame:
    """(item, query, position, doc, document, source_missing): one row for every class of every item's inventory, in its order.

    queries: item, query; inventory: item, position, doc; texts: doc, text. A class without source is its name alone. No
    labels are read.
    """
    j = inventory.join(texts.select("doc", "text"), "doc", "left").join(queries, "item")
    return j.select("item", "query", "position", "doc", T.compose_document(F.col("doc"), F.col("text")).alias("document"), F.col("text").isNull().alias("source_missing"))


def input_signature(inputs: DataFrame) -> DataFrame:
    """(item, signature): SHA-256 over query, documents, tokenizer and ranking settings. Documents count by their sorted digests, so their sum needs one row an item."""
    each = inputs.select("item", "query", F.sha2(F.concat_ws("\0", "position", "doc", "document"), 256).alias("digest"))
    rolled = each.groupBy("item").agg(F.first("query").alias("query"), F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)])
    settings = F.lit(f"{tokenizer_fingerprint()}:{S.K1}:{S.B}:{S.SHORTLIST_CAP}")
    return rolled.select("item", F.sha2(F.concat_ws("\0", settings, "query", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("signature"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cache_plan(wanted: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(signatures to rank, stored rows to reuse). Stored rows: item, signature, doc, rank, score, n.

    A stored ranking counts if it is whole: ranks 1..n once each with finite scores.
    """
    if stored is None:
        return wanted, None
    span = stored.groupBy("item", "signature").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.max("n").alias("m"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"))
    sound = span.filter("c = d and lo = 1 and hi = c and m = c and bad = 0").select("item", "signature")
    hit = wanted.join(sound, ["item", "signature"])
    return wanted.join(hit, ["item", "signature"], "left_anti"), stored.join(hit, ["item", "signature"])


def cached_ranking(wanted: DataFrame, path: str, rank) -> DataFrame:
    """Rankings of all wanted (item, signature): those stored under the same signature, and new ones, which are added to the store.

    rank: a function from (item, signature) rows to (item, signature, doc, rank, score, n).
    """
    spark = wanted.sparkSession
    todo, _ = cache_plan(wanted, _stored(spark, path))
    if not todo.isEmpty():
        rank(todo).write.mode("append").parquet(path)
    _, whole = cache_plan(wanted, _stored(spark, path))
    return wanted.limit(0).select("item", "signature") if whole is None else whole.dropDuplicates(["item", "signature", "rank"])


def persistence_plan(built: DataFrame, stored: DataFrame | None, locks: DataFrame, force: bool = False) -> DataFrame:
    """(item, outcome): written, reused, regenerated, or locked where another shortlist is stored under a lock.

    built, stored: item, sha256 of the shortlist, signature; locks: item.
    """
    old = built.limit(0) if stored is None else stored
    j = built.join(old.select("item", F.col("sha256").alias("old_sha"), F.col("signature").alias("old_signature"), F.lit(True).alias("there")), "item", "left")
    j = j.join(locks.select("item", F.lit(True).alias("lock")).distinct(), "item", "left")
    same = F.coalesce((F.col("old_sha") == F.col("sha256")) & (F.col("old_signature") == F.col("signature")), F.lit(False))
    outcome = F.when(same, "reused").when(F.col("lock") & F.lit(not force), "locked").when(F.col("there"), "regenerated").otherwise("written")
    return j.select("item", outcome.alias("outcome"))


def save_shortlists(built: DataFrame, path: str, locks: DataFrame, force: bool = False) -> DataFrame:
    """Stores shortlists and returns the plan that was carried out; an error, with nothing written, if a lock stands in the way.

    Each call writes a new version and then names it, so readers see the old shortlists or the new ones, never a mixture.
    """
    spark = built.sparkSession
    old = load_shortlists(spark, path)
    plan = cut(persistence_plan(built, old, locks, force))
    outcomes = {r["outcome"]: (r["n"], r["h"]) for r in plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("h")).collect()}  # four rows at most
    if "locked" in outcomes:
        bad = [r["item"] for r in plan.filter("outcome = 'locked'").orderBy("item").limit(5).collect()]
        raise PermissionError(f"locked shortlists would change: {bad}")
    if set(outcomes) - {"reused"}:
        version = hashlib.sha256(repr((sorted(outcomes.items()), len(_versions(spark, path)))).encode()).hexdigest()[:16]
        keep = built if old is None else built.unionByName(old.join(built.select("item"), "item", "left_anti").select(*built.columns))
        keep.write.parquet(f"{path}/{version}")
        spark.createDataFrame([(len(_versions(spark, path)), version)], "turn long, version string").write.mode("append").json(f"{path}/versions")
    return plan


def _versions(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema("turn long, version string").json(f"{path}/versions").orderBy("turn").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def load_shortlists(spark: SparkSession, path: str) -> DataFrame | None:
    """The shortlists of the last version, or None."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/{versions[-1]['version']}") if versions else None


def shortlist_rows(ids: Column) -> Column:
    """The digest of a shortlist's ids in order, each ended by a line feed."""
    return F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256)
