"""The locked manifest: splits in manifest order, membership, the evaluation lock, ID order, positions, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import require_empty
from .order import numbered

LOCK_TAG = "experiment-v1"  # fixed value


def manifest_violations(manifest: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(rule, id, n) over (split, position, id): ids listed twice, ids of several splits, splits of another size than expected."""
    ids = manifest.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))
    twice = ids.filter("n > 1 and splits = 1").select(F.lit("duplicate").alias("rule"), "id", "n")
    both = ids.filter("splits > 1").select(F.lit("overlap").alias("rule"), "id", "n")
    want = manifest.sparkSession.createDataFrame([(k, v) for k, v in expected.items()], "split string, want long")
    sizes = want.join(manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").filter("coalesce(n, 0) <> want")
    return twice.unionByName(both).unionByName(sizes.select(F.lit("size").alias("rule"), F.col("split").alias("id"), F.coalesce("n", F.lit(0)).alias("n")))


def split_rows(manifest: DataFrame, split: str, expected: dict[str, int] | None = None) -> DataFrame:
    """(id, index): a split's ids with their zero-based place in manifest order; an error for a manifest that breaks its rules."""
    if expected:
        require_empty(manifest_violations(manifest, expected), "manifest")
    return numbered(manifest.filter(F.col("split") == split), "position", name="index").select("id", "index")


def seeds(rows: DataFrame, base: int) -> DataFrame:
    """Adds seed = base + index."""
    return rows.withColumn("seed", F.lit(base) + F.col("index"))


def evaluation_allowed(lock: DataFrame | None, tag: str = LOCK_TAG) -> None:
    """An error unless the one lock row (tag, validated, commit_sha) is there and sound."""
    rows = [] if lock is None else lock.select("tag", "validated", "commit_sha").limit(2).collect()
    if len(rows) != 1:
        raise PermissionError("evaluation blocked: no lock" if not rows else "evaluation blocked: several locks")
    row = rows[0]
    if row["tag"] != tag or row["validated"] is not True or not row["commit_sha"]:
        raise PermissionError(f"evaluation blocked: tag {row['tag']!r}, validated {row['validated']!r}, commit {row['commit_sha']!r}")


def membership(rows: DataFrame, manifest: DataFrame, lock: DataFrame | None = None, allow_evaluation: bool = False) -> DataFrame:
    """rows (with id) plus their split; ids that no split lists go. Evaluation rows only if allowed, and then only under the lock."""
    if allow_evaluation:
        evaluation_allowed(lock)
    wanted = manifest if allow_evaluation else manifest.filter("split = 'development'")
    return rows.join(wanted.select("id", "split").distinct(), "id")


def id_order(qualified: Column) -> tuple[Column, Column]:
    """Order of `Project-N`: project as text, N as a number."""
    return F.substring_index(qualified, "-", 1), F.substring_index(qualified, "-", -1).try_cast("long")


def by_id(df: DataFrame, qualified: str, name: str = "position") -> DataFrame:
    """Adds the place in the order of ids, from 1."""
    return numbered(df, *id_order(F.col(qualified)), qualified, name=name).withColumn(name, F.col(name) + 1)


def ordered_lookup(inventory: DataFrame, texts: DataFrame, by: list[str], key: str, text: str) -> DataFrame:
    """inventory with each key's text, position kept; an absent or empty text stays as a null, for lookup_violations()."""
    return inventory.join(texts.select(*by, key, text), [*by, key], "left").withColumn(text, F.when(F.col(text) != "", F.col(text)))


def lookup_violations(looked_up: DataFrame, by: list[str], key: str, text: str) -> DataFrame:
    return looked_up.filter(F.col(text).isNull()).select(F.lit("no text").alias("rule"), *by, key)


def annotate(selection: DataFrame, notes: DataFrame, key: str, categories: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(annotated selection, violations): notes must name the selected keys at the same positions, in known categories, with evidence.

    Both have key and position; notes also category and evidence.
    """
    own = notes.withColumnRenamed("position", "note_position")
    j = selection.join(own, key, "full_outer")
    known = F.coalesce(F.col("category").isin(*categories), F.lit(False))
    rule = F.when(F.col("note_position").isNull(), "not annotated").when(F.col("position").isNull(), "not selected").when(F.col("position") != F.col("note_position"), "order")
    rule = rule.when(~known, "category").when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "evidence")
    return j.filter("position is not null and note_position is not null").drop("note_position"), j.select(rule.alias("rule"), key).filter("rule is not null")


def arm_ranks(rows: DataFrame, arm: str, *order: Column) -> DataFrame:
    """Adds the rank within the arm, from 1."""
    return rows.withColumn("arm_rank", F.row_number().over(Window.partitionBy(arm).orderBy(*order)).cast("long"))
