"""Drift between two states of a table, found from the root of a tree of digests.

Keys are ordered by their md5, whose leading hex digits are the path of a key's leaf. A leaf's digest comes from the count and
two sums of the hashes of its rows, so no leaf is ever collected; a node's is the SHA-256 of its children's (16 at most). Two
trees are compared from the root: a level reads only the nodes below unequal ones, and in the end only the rows of unequal
leaves are read and compared. Rows lie in folders by the first digits, so equal subtrees aren't opened.

A repeated key makes a row of drift for each pair of its rows that differs. Null keys are keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .audit import drift

FAN, FOLDER = 16, 2  # children of a node (a hex digit); digits of a folder's name
PER_LEAF = 256


def depth_for(rows: int, per_leaf: int = PER_LEAF) -> int:
    """Levels below the root, for about so many rows a leaf; the folders' digits at least."""
    depth = FOLDER
    while FAN**depth * per_leaf < rows:
        depth += 1
    return depth


def build(rows: DataFrame, keys: list[str], facts: list[str], path: str, depth: int) -> None:
    """Writes the rows by leaf, and the tree (level, node, parent, digest, n)."""
    key = F.md5(F.to_json(F.struct(*keys)))
    own = rows.select(*keys, *facts, F.substring(key, 1, depth).alias("leaf")).withColumn("folder", F.substring("leaf", 1, FOLDER))
    own.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/types")  # what a table without rows is read with
    own.repartition("folder", "leaf").sortWithinPartitions("folder", "leaf").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/rows")
    text = F.to_json(F.struct(*keys, *facts), {"ignoreNullFields": "false"})
    hashes = [F.xxhash64(F.lit(salt), text).cast("decimal(38,0)") for salt in (1, 2)]
    level = own.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(hashes)])
    level = cut(level.select("node", F.sha2(F.concat_ws("/", "n", "h0", "h1"), 256).alias("digest"), "n"))
    for at in range(depth, -1, -1):
        level.withColumns({"level": F.lit(at), "parent": F.substring("node", 1, max(0, at - 1))}).write.mode("append" if at < depth else "overwrite").partitionBy("level").parquet(f"{path}/tree")
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FAN at most
        if at:
            up = level.groupBy(F.substring("node", 1, at - 1).alias("node")).agg(F.sha2(F.to_json(children), 256).alias("digest"), F.sum("n").alias("n"))
            level = cut(up)


def _level(spark: SparkSession, path: str, at: int) -> DataFrame:
    return spark.read.schema("node string, digest string, n long, parent string, level int").parquet(f"{path}/tree").filter(F.col("level") == at).select("node", "parent", "digest", "n")


def unequal_leaves(spark: SparkSession, a: str, b: str, depth: int) -> tuple[DataFrame, int]:
    """(leaves (node) that differ, nodes read on the way)."""
    below, read = None, 0
    for at in range(depth + 1):
        sides = [_level(spark, p, at) for p in (a, b)]
        if below is not None:
            sides = [s.join(below.select(F.col("node").alias("parent")), "parent", "left_semi") for s in sides]
        both = sides[0].select("node", F.col("digest").alias("x")).join(sides[1].select("node", F.col("digest").alias("y")), "node", "full_outer")
        both = cut(both)
        read += both.count()
        below = both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        if below.isEmpty():
            break
    return below, read


def drifted(spark: SparkSession, a: str, b: str, keys: list[str], facts: list[str], depth: int) -> DataFrame:
    """(keys, expected, observed, status) of the rows that differ between tree a and tree b: missing, unexpected or changed."""
    leaves, _ = unequal_leaves(spark, a, b, depth)
    leaves = cut(leaves.select(F.col("node").alias("leaf"), F.substring("node", 1, FOLDER).alias("folder")))
    folders = [r[0] for r in leaves.select("folder").distinct().collect()]  # FAN ** FOLDER at most
    types = spark.read.parquet(f"{a}/types").schema
    some = lambda p: spark.read.schema(types).parquet(f"{p}/rows").filter(F.col("folder").isin(folders)).join(leaves.select("leaf"), "leaf", "left_semi")
    return drift(some(a), some(b), keys, facts).filter("status <> 'same'")
