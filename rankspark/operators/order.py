"""Places in an order and ranks within groups, without a window over a whole group.

Rows are dealt into ranges of the order, every task numbers its own range, and a range starts where the ranges before it end:
prefix sums over one row a range. So a group may be larger than a task's memory, and all rows may be one group. The numbered
rows are written once, as the ranges of a plan that runs twice need not be the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

FEW_GROUPS = 100_000


def small(table: DataFrame, most: int = FEW_GROUPS) -> DataFrame:
    """A written table, marked to be broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """df with each row's place in the order, from 0; rows that the order doesn't tell apart stand in any order, but in one."""
    own = F.monotonically_increasing_id()  # the range's number in the upper bits, the row's in the lower 33
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(spread.withColumn("_at", own)).withColumn("_range", F.shiftright("_at", 33)).withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range: as many as tasks
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def ranked(df: DataFrame, by: list[str], *order: Column | str, name: str = "rank", size: str | None = None) -> DataFrame:
    """df with each row's rank in its group, from 1, and on request the group's size; nulls in `by` are one group."""
    placed = numbered(df, *by, *order, name="_place").withColumn("_g", F.struct(*by))
    groups = cut(placed.groupBy("_g").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size")))
    out = placed.join(small(groups), "_g").withColumn(name, F.col("_place") - F.col("_first") + 1)
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_place", "_g", "_first", "_size")
