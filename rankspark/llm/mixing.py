"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a seeded hash, form one stream of words, read in turns. The golden-ratio points
frac((i + 1/2) / phi), taken exactly in integers and mapped through the cumulative targets, say how many words each source
gives, at every size of the table: a point for each word, counted by a floor sum, with no point made. After PERIOD points they
repeat; whole periods are shifted against each other by equal parts of a point's width, so a source has its share of them to a word.

The order of the mix is a schedule of blocks of BLOCK words (a source's last one may be shorter). Slot i has point i mapped
through the cumulative numbers of blocks, which names a source; the slot's rank among its source's slots names the block of its
stream. So every stretch of the mix holds the sources in their shares. A block finds its slot by inverting the same floor sum;
mixed_documents() brings each document to the slot of the block that its copy starts in.

Sizes are words `[^\x20\x09-\x0D]+`; null texts have none. Null sources are a source of their own, the last. Null ids hash as
empty ones. A table without words has targets and takes of 0. Repeated rows count each by itself; rows of one id and size are
ordered by their texts' hash, so reruns agree. Windows over sources hold one row a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import kernels as K

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 17
SLOTS = 1 << 22  # up to so many words the SQL of op7 counts slots as this module does; beyond, it takes coarser blocks
PERIOD, GOLDEN = 1 << 31, 1_327_217_885  # 2^31 / phi, made odd
BLOCK, BUCKET_ROWS = 1_024, 20_000


def word_count(text) -> F.Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target, lo, hi, total): one row per source; lo..hi is its part of the whole.

    A target is the least of its cap and level x weight, with the level that makes all targets sum to the total: sources in
    the order of cap / weight fill up first. The windows run over distinct sources, not rows.
    """
    one = Window.partitionBy(F.lit(0))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("position", n).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("total", F.sum("source_size").over(one))
    order = one.orderBy(F.col("cap") / F.col("weight"), "position")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / rest)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("at"), "position", "level"))).over(one)["level"])
    per = per.withColumn("target", F.when(F.col("total") > 0, F.least("cap", F.col("level") * F.col("weight"))).otherwise(0.0))
    hi = F.sum("target").over(one.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("target")).drop("level", "cap")


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """Sum of floor((a i + b) / m) over 0 <= i < n."""
    out = 0
    while True:
        out += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        if top < m:
            return out
        n, b, m, a = top // m, top % m, a, m


def slots_below(place: float, total: int, period: int = PERIOD, golden: int = GOLDEN) -> int:
    """How many of the schedule's `total` slots have a point below a place in 0..total."""
    point = lambda turn: (turn + 0.5) / float(period) * float(total)
    turns = min(max(int(place / total * period), 0), period)  # turns with a point below the place
    while turns < period and point(turns) < place:
        turns += 1
    while turns and point(turns - 1) >= place:
        turns -= 1
    cycles, rest = divmod(total, period)
    whole = min(max(round(place / total * cycles * period), 0), cycles * period)
    return whole + rest + floor_sum(rest, period, golden, 0) - floor_sum(rest, period, golden, period - turns)


def slot_counts(targets: DataFrame) -> DataFrame:
    """(position, slots): the number of slots of every source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lo, hi, total = (c.to_pylist() for c in b.columns)
            n = [max(0, slots_below(y, t) - slots_below(x, t)) for x, y, t in zip(lo, hi, total, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["position", "slots"])

    return targets.filter("target > 0").select("position", "lo", "hi", "total").mapInArrow(run, "position int, slots long")


def floor_sums(n: np.ndarray, m: int, a: int, b: np.ndarray) -> np.ndarray:
    """floor_sum() of arrays n and b; m and all numbers up to 2^31."""
    n, b = n.astype(np.int64), b.astype(np.int64)
    out, m, a = np.zeros(len(n), np.int64), np.full(len(n), m), np.full(len(n), a)
    todo = np.arange(len(n))
    while len(todo):
        out[todo] += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        go = top >= m
        todo, n, b, m, a = todo[go], (top // m)[go], (top % m)[go], a[go], m[go]
    return out


def slot_of(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, period: int = PERIOD, golden: int = GOLDEN) -> np.ndarray:
    """The slot that is number `rank` of those whose point lies in lo..hi - 1 of 0..period - 1; -1 where lo = hi."""
    width = hi - lo
    cycle, r = np.divmod(rank, np.maximum(width, 1))

    def count(n: np.ndarray, at: np.ndarray) -> np.ndarray:
        return floor_sums(n, period, golden, period - lo[at]) - floor_sums(n, period, golden, period - hi[at])

    share = np.maximum(width, 1) / period
    low = np.clip(np.floor((r - 64) / share), 0, period).astype(np.int64)
    high = np.clip(np.ceil((r + 64) / share), 0, period).astype(np.int64)
    every = np.arange(len(r))
    low[count(low, every) > r] = 0
    high[count(high, every) <= r] = period
    todo = np.flatnonzero(high - low > 1)  # at most r points before low, more than r before high
    while len(todo):
        middle = (low[todo] + high[todo]) // 2
        enough = count(middle, todo) > r[todo]
        high[todo[enough]] = middle[enough]
        low[todo[~enough]] = middle[~enough]
        todo = todo[high[todo] - low[todo] > 1]
    return np.where(width > 0, cycle * period + low, -1)


def taken(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, source, size, source_size, target, taken, copies, part, place, blocks, slots, lo, hi, *keep): what the mix takes of each row.

    taken = copies x size + part: whole turns through the stream, and the words of the last, unfinished turn. place: words
    before it in its source's stream; blocks: its source's, slots: all, lo..hi: its source's points.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))))
    sized = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h"), F.xxhash64(text).alias("tie"), *keep)
    digits = int(np.clip(np.ceil(np.log(max(1, docs.count()) / BUCKET_ROWS) / np.log(16)), 3, 5))
    if not keep:
        sized = K.cut(sized)  # the texts are read once
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key")  # null is a source too
    # places in the stream: sums of hash buckets first, then a window within each bucket, so that no source is one task;
    # the plan goes by the same keys, so rows with their texts move once
    bucket = F.conv(F.substring("h", 1, digits), 16, 10).cast("int").alias("bucket")
    sums = K.cut(sized.groupBy("source", key, bucket).agg(F.sum("size").alias("sum")))
    targets = K.cut(source_targets(sums.select("source", F.col("sum").alias("size")), weights, max_epochs))
    plan = targets.join(slot_counts(targets), "position", "left")
    used = F.least(F.coalesce("slots", F.lit(0)), F.col("source_size") * max_epochs)
    plan = plan.withColumn("turns", F.when(F.col("source_size") > 0, F.floor(used / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("upto", F.when(F.col("source_size") > 0, used - F.col("turns") * F.col("source_size")).otherwise(0).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(used / BLOCK).cast("long"))
    one = Window.partitionBy(F.lit(0))
    points = lambda blocks: F.floor(blocks / F.greatest(F.col("slots"), F.lit(1)) * PERIOD).cast("long")
    plan = plan.withColumn("slots", F.sum("blocks").over(one)).withColumn("end", F.sum("blocks").over(one.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    plan = plan.select(key, "source_size", "target", "turns", "upto", "blocks", "slots", points(F.col("end") - F.col("blocks")).alias("lo"), points(F.col("end")).alias("hi"))
    before = F.sum("sum").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("sum")
    sums = sums.select("source_key", "bucket", before.alias("before")).join(plan, "source_key", "left")
    own = Window.partitionBy("source_key", "bucket").orderBy("h", "doc", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.select("*", key, bucket).withColumn("start", F.sum("size").over(own) - F.col("size"))
    out = placed.join(sums, ["source_key", "bucket"], "left").withColumn("place", F.col("before") + F.col("start"))
    part = F.least(F.greatest(F.col("upto") - F.col("place"), F.lit(0)), F.col("size"))
    out = out.withColumn("part", part.cast("long")).withColumn("copies", F.col("turns"))
    return out.select("doc", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "copies", "part", "place", "blocks", "slots", "lo", "hi", *keep)


@F.pandas_udf(LongType())
def _slot(rank: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    table, at = np.unique(np.stack([rank.to_numpy(np.int64), lo.to_numpy(np.int64), hi.to_numpy(np.int64)], 1), axis=0, return_inverse=True)
    return pd.Series(slot_of(table[:, 0], table[:, 1], table[:, 2])[at.ravel()])


def mixed_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", slot: str | None = None, **options) -> DataFrame:
    """The mix as rows: each document as often as the schedule takes it; the one that a source's last turn cuts gives its first words.

    Columns of docs stay; `slot` names one more for the row's slot. Rows come in the order of their slots: a partition holds
    a stretch of the mix, in order. Documents without words stay once, at slots by their hash: they cost no words.
    """
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}  # no name of docs can clash
    kept = tuple(names[c] for c in docs.columns if c not in (doc, source))
    out = taken(docs.toDF(*names.values()), names[doc], names[text], names[source], keep=kept, **options)
    whole = F.col("copies").cast("int") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    whole = F.when(F.col("size") == 0, 1).otherwise(whole)
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    words = F.regexp_extract_all(names[text], F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    piece = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    full = F.when(whole > 0, F.array_repeat(F.col(names[text]), whole)).otherwise(F.array().cast("array<string>"))
    texts = F.when(cut, F.concat(full, F.array(piece))).otherwise(full)
    rows = out.select("*", F.posexplode(texts).alias("_turn", "_text")).withColumn("_at", F.col("_turn") * F.col("source_size") + F.col("place"))
    last = F.greatest(F.coalesce("blocks", F.lit(0)) - 1, F.lit(0))
    rank = F.least(F.floor(F.col("_at") / BLOCK).cast("long"), last)
    rows = rows.withColumn("_slot", _slot(rank, F.coalesce("lo", F.lit(0).cast("long")), F.coalesce("hi", F.lit(0).cast("long"))))
    rows = rows.withColumn("_slot", F.when(F.col("_slot") >= 0, F.col("_slot")).otherwise(F.coalesce("slots", F.lit(0)) + rank))
    rows = rows.withColumn("_slot", F.when(F.col("size") > 0, F.col("_slot")).otherwise(F.pmod(F.xxhash64("doc", "_at"), F.greatest(F.coalesce("slots", F.lit(0)), F.lit(1)).cast("long"))))  # no words, no block
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.least(F.floor(F.col("_slot") / F.greatest(F.col("slots"), F.lit(1)) * parts), F.lit(parts - 1)).cast("int")
    rows = rows.repartitionById(parts, stretch).sortWithinPartitions("_slot", "_at", "doc", "_text")
    pick = {doc: "doc", source: "source", text: "_text"}
    return rows.select(*[F.col(pick.get(c, n)).alias(c) for c, n in names.items()], *([F.col("_slot").alias(slot)] if slot else []))
