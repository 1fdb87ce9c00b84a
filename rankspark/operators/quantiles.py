"""Exact percentiles of groups of any size, by refining ranges.

A percentile with linear interpolation lies between two neighbours in the order of its group, so what is sought are the values
at certain places. For each place, a pass takes a sketch of the values still possible, picks two that should enclose the place,
and counts exactly how many values lie below, at, between and above the two: either one of them is the value, or the next pass
looks only where the counts say. The sketch's error decides how fast the range shrinks, not what comes out. One pass leaves
about 5 of GRID parts, so 10^12 values take four or five. What is kept for a place is the sketch and a few numbers. Where FEW
values or less are left they are sorted as they are; a value may repeat as often as it likes.

Nulls don't count. NaN is the largest value, as in Spark's order. A group without values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop_cut
from .order import small

GRID, ACCURACY, FEW, PASSES = 1_024, 10_000, 100_000, 40


def _possible(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows that may hold the state's places: those strictly between their bounds."""
    v, low, high = F.col("_v"), F.col("low"), F.col("high")
    return rows.join(small(state), "_g").filter((low.isNull() | (v > low)) & (high.isNull() | (v < high)))


def _narrowed(rows: DataFrame, state: DataFrame, grid: int) -> DataFrame:
    """state after one sketch and one count."""
    shares = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    marks = _possible(rows, state).groupBy("_g", "place").agg(F.percentile_approx("_v", shares, ACCURACY).alias("marks"))
    share = F.col("k") * grid / F.col("inside")
    at = lambda i: F.get("marks", F.greatest(F.lit(0), F.least(F.lit(grid), i.cast("int"))))
    told = cut(state.join(marks, ["_g", "place"]).select(*state.columns, at(F.floor(share) - 2).alias("a"), at(F.ceil(share) + 2).alias("b")))
    v, a, b = F.col("_v"), F.col("a"), F.col("b")
    count = lambda c, name: F.count_if(c).alias(name)
    n = _possible(rows, told).groupBy("_g", "place").agg(count(v < a, "n0"), count(v == a, "n1"), count((v > a) & (v < b), "n2"), count((v == b) & (a != b), "n3"), count(v > b, "n4"))
    j, k = told.join(n, ["_g", "place"]), F.col("k")
    ends = [F.col("n0"), F.col("n0") + F.col("n1"), F.col("n0") + F.col("n1") + F.col("n2"), F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")]
    part = F.when(k < ends[0], 0).when(k < ends[1], 1).when(k < ends[2], 2).when(k < ends[3], 3).otherwise(4)
    j = j.withColumn("part", part)
    pick = lambda *by: F.when(F.col("part") == 0, by[0]).when(F.col("part") == 2, by[1]).when(F.col("part") == 4, by[2])
    low, high = F.col("low"), F.col("high")
    return cut(j.select("_g", "place", pick(low, a, b).alias("low"), pick(a, b, high).alias("high"), F.coalesce(pick(k, k - ends[1], k - ends[3]), F.lit(0)).alias("k"),
                        F.coalesce(pick(F.col("n0"), F.col("n2"), F.col("n4")), F.lit(0)).alias("inside"), F.when(F.col("part") == 1, a).when(F.col("part") == 3, b).alias("value")))


def at_places(rows: DataFrame, places: DataFrame, few: int = FEW, grid: int = GRID) -> DataFrame:
    """(_g, place, value): the values of rows (_g, _v) at the places (_g, place, inside) of their groups, from 0."""
    start = places.select("_g", "place", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("place").alias("k"), "inside", F.lit(None).cast("double").alias("value"))
    state = cut(start)
    for _ in range(PASSES):
        wide = state.filter(F.col("value").isNull() & (F.col("inside") > few))
        if wide.isEmpty():
            break
        near = _narrowed(rows, wide, grid)
        new = cut(state.filter(F.col("value").isNotNull() | (F.col("inside") <= few)).unionByName(near))
        drop_cut(state, near)
        state = new
    else:
        raise RuntimeError("percentiles did not settle")
    left = state.filter(F.col("value").isNull())
    held = _possible(rows, left).groupBy("_g", "place", "k").agg(F.sort_array(F.collect_list("_v")).alias("v"))  # `few` values at most
    near = held.select("_g", "place", F.get("v", F.col("k").cast("int")).alias("value"))
    return near.unionByName(state.filter(F.col("value").isNotNull()).select("_g", "place", "value"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: Sequence[float], few: int = FEW, grid: int = GRID) -> DataFrame:
    """(by, share, value): every group's linear-interpolated percentile at every share in [0, 1]."""
    rows = df.select((F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    at = F.col("share") * (F.col("n") - 1)
    wanted = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = cut(wanted.select("_g", "share", "n", F.floor(at).alias("first"), F.ceil(at).alias("second"), (at - F.floor(at)).alias("part")))
    places = wanted.select("_g", F.explode(F.array("first", "second")).alias("place"), F.col("n").alias("inside")).distinct()
    found = cut(at_places(rows, places, few, grid))
    one = lambda place, name: found.select("_g", F.col("place").alias(place), F.col("value").alias(name))
    both = wanted.join(one("first", "a"), ["_g", "first"]).join(one("second", "b"), ["_g", "second"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return both.select(*[F.col(f"_g.{c}").alias(c) for c in by], "share", between.alias("value"))
