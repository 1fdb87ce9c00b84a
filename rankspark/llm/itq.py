"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Fit, on a bounded sample of SAMPLE vectors: principal directions, then a rotation that brings the projections close to their
signs; directions beyond the dimension, or beyond WIDTH of them, come from further rotations, each learned from a random
start. Codes are the signs of centred projections, so that they stay balanced where vectors have much in common; what is
compared with the threshold is the cosine of the vectors as they are. Every distinct vector gets a code; the index has one table
for each key, a piece of the code. Vectors with an equal key meet, and all pairs that meet are compared by cosine on the
original vectors, in double precision. A pair that meets in several tables counts in the first only.

Keys grow with the rows, by one bit as they double. A pair right at the threshold is at a wider angle once centred, the more
its vectors have in common with the mean; it has a bit equal with probability 1 - angle / pi. There are as many tables as
leave, over the sample's vectors, a share of MISS of such pairs without any equal key, and a share of 2 / dimension more, as
bits of few dimensions depend on each other; closer pairs are missed less. Where the
tables together would compare more pairs than there are, as vectors hardly differ from their mean, all pairs are compared
instead, in blocks.

Equal vectors are one entry with a weight. A bucket of more than BLOCK entries is dealt out as pairs of blocks. Tasks return
counts of links and a forest of connecting links, never the pairs. Vectors travel as they are given, floats as floats.

Vectors of each length are linked among themselves. Vectors that are null, empty, zero or hold null or non-finite numbers link
with nothing and stay.
A null id has null component and kept true if alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import vectors as V

SAMPLE, ROUNDS, MORE_ROUNDS, WIDTH, BLOCK, BUCKET, SEED = 20_000, 50, 1, 64, 2_048, 20_000, 1
AIM, LEAST_BITS, MOST_BITS, MOST_TABLES, MISS = 512, 8, 24, 1_024, 0.0075
THRESHOLD, SLACK = 0.9, 1e-9


def layout(n_rows: int, threshold: float = THRESHOLD, x: np.ndarray | None = None, d: int = 64) -> tuple[int, int] | None:
    """(bits a key, tables) for the share of MISS; None where no MOST_TABLES reach it. x: sampled unit vectors of d numbers, without a common mean unless given."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n_rows) / AIM)), LEAST_BITS, MOST_BITS))
    rest = np.ones(1)
    if x is not None and len(x):
        mean = x.mean(axis=0)
        rest = np.maximum(1 - 2 * (x @ mean) + mean @ mean, 1e-12)  # squared lengths once centred
    same = (1 - np.arccos(np.clip(1 - (1 - threshold) / rest, -1, 1)) / np.pi) ** bits
    low, high = 0, 1
    while ((1 - same) ** high).mean() > MISS:
        low, high = high, 2 * high
        if high > 2 * MOST_TABLES:
            return None
    while high - low > 1:
        half = (low + high) // 2
        low, high = (low, half) if ((1 - same) ** half).mean() <= MISS else (half, high)
    tables = int(np.ceil(high * (1 + 2 / d)))
    return (bits, tables) if tables <= MOST_TABLES else None


def compared(keys_: np.ndarray) -> float:
    """The pairs that tables compare, as a share of all, told by a sample's keys: one row a vector."""
    n = len(keys_)
    return sum(float((np.unique(k, return_counts=True)[1].astype(float) ** 2 - 1).sum()) for k in keys_.T) / max(1, n * (n - 1))


def fit(x: np.ndarray, bits: int) -> np.ndarray:
    """Projection d x bits of unit vectors, taken from their mean."""
    d, rng, out = x.shape[1], np.random.default_rng(SEED), []
    x = x - x.mean(axis=0)
    basis, rounds, held = np.linalg.eigh(x.T @ x)[1][:, ::-1], ROUNDS, 0
    while held < bits:
        for at in range(0, d, WIDTH):
            axes = basis[:, at : at + WIDTH]
            z = x @ axes
            r = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
                r = (u @ vt).T
            out.append(axes @ r)
            held += axes.shape[1]
            if held >= bits:
                break
        basis, rounds = np.linalg.qr(rng.standard_normal((d, d)))[0], MORE_ROUNDS
    return np.hstack(out)[:, :bits]


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys(x: np.ndarray, projection: np.ndarray, bits: int, mean: np.ndarray | float = 0.0) -> np.ndarray:
    """The keys of unit vectors, a column for each table; without bits all are 0."""
    if not bits:
        return np.zeros((len(x), 1), np.uint32)
    on = ((x - mean) @ projection >= 0).reshape(len(x), -1, bits)
    return (on.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def block_pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, within: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two lists of vectors x, y whose product reaches the threshold, but for rounding, and whose keys a, b of earlier tables all differ."""
    for at in range(0, len(x), 512):
        ok = x[at : at + 512] @ y.T >= threshold - SLACK
        if within:
            ok &= np.arange(len(y))[None, :] > np.arange(at, at + len(ok))[:, None]
        i, j = np.nonzero(ok)
        for t in range(a.shape[1]):
            keep = a[i + at, t] != b[j, t]
            i, j = i[keep], j[keep]
        for s in range(0, len(i), 100_000):
            yield i[s : s + 100_000] + at, j[s : s + 100_000]


def bucket_links(ids: np.ndarray, w: np.ndarray, earlier: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, within: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each entry by weight, connecting links) of one bucket or pair of blocks."""
    links, up, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for i, j in block_pairs(earlier[left], earlier[right], x[left], x[right], within, threshold):
        i, j = left[i], right[j]
        near = (x[i] * x[j]).sum(axis=1) >= threshold
        i, j = i[near], j[near]
        np.add.at(links, i, w[j])
        np.add.at(links, j, w[i])
        while len(i):  # connect what isn't yet, one vectorised round at a time
            a, b = up[i], up[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            forest.append((int(ids[i[0]]), int(ids[j[0]])))
            up[up == max(a[0], b[0])] = min(a[0], b[0])
    return links, forest


def found_links(classes: DataFrame, d: int, number: type, threshold: float) -> DataFrame:
    """(a, b, links) of distinct vectors (k1, w, v) of length d: what bucket_links() gives of all buckets."""
    n_rows, x = classes.count(), unit(V.sample(classes, "k1", "v", SAMPLE, d))
    mean, made = x.mean(axis=0), layout(n_rows, threshold, x, d)
    bits, tables = made or (0, 1)
    projection = fit(x, bits * tables) if bits else np.zeros((d, 0))
    if bits and compared(keys(x, projection, bits, mean)) >= 1:
        bits, tables, projection = 0, 1, np.zeros((d, 0))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                m = V.matrix(c.column(2), d)
                k = keys(unit(m), projection, bits, mean)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * tables), pa.array(k.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([r.tobytes() for r in m.astype(number)], pa.binary()), lists, pa.array([r.tobytes() for r in k], pa.binary())], names=["k1", "w", "x", "each", "keys"])

    # one row a table; buckets of more than BLOCK entries become pairs of blocks, small ones share a task with others
    placed = classes.select("k1", "w", "v").mapInArrow(index, "k1 long, w long, x binary, each array<int>, keys binary").select("k1", "w", "x", "keys", F.posexplode("each").alias("t", "key"))
    size = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    placed = placed.join(size, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "k1", "w", "x", "keys")
    times = tables if bits else -(-n_rows // BLOCK)  # how often a row is dealt out
    buckets = max(16, n_rows * times // BUCKET)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(buckets).cast("long")))

    def run(table: pa.Table) -> pa.Table:
        t, key_, i, j, side, ids, w = (table.column(c).to_numpy() for c in ("t", "key", "i", "j", "side", "k1", "w"))
        x, _ = K.raw(table.column("x"))
        raw, _ = K.raw(table.column("keys"))
        x, ks = np.frombuffer(x.tobytes(), number).reshape(-1, d), np.frombuffer(raw.tobytes(), np.uint32).reshape(len(t), -1)
        order = np.lexsort((ids, j, i, key_, t))
        groups = [c[order] for c in (t, key_, i, j)]
        cuts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([g[1:] != g[:-1] for g in groups]), [True]))) if len(order) else [0]
        out: list[list] = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = order[a:b]
            within = i[some[0]] == j[some[0]]
            left = np.arange(len(some)) if within else np.flatnonzero(side[some] == 0)
            right = left if within else np.flatnonzero(side[some] == 1)
            if len(some) < 2 or not len(left) or not len(right):
                continue
            links, forest = bucket_links(ids[some], w[some], ks[some, : t[some[0]]], unit(x[some].astype(np.float64)), left, right, within, threshold)
            has = np.flatnonzero(links)
            out[0] += [*ids[some][has].tolist(), *(f[0] for f in forest)]
            out[1] += [*[None] * len(has), *(f[1] for f in forest)]
            out[2] += [*links[has].tolist(), *[0] * len(forest)]
        return pa.Table.from_arrays([pa.array(o, pa.int64()) for o in out], names=["a", "b", "links"])

    return K.cut(dealt.groupBy("bucket").applyInArrow(run, "a long, b long, links long"))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept): one row per input row."""
    v = F.col(vector).cast("array<double>")
    own = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    kind, number = ("float", np.float32) if dict(rows.dtypes)[vector] == "array<float>" else ("double", np.float64)
    every = rows.select(F.col(key).cast("long").alias("id"), F.when(V.usable(own), own).alias("v"))
    every = every.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)))  # -0 is 0
    every = every.withColumn("k1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("k2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v")))
    classes = every.filter("v is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    classes = K.cut(classes)
    found = None
    for (d,) in sorted(tuple(r) for r in classes.select(F.size("v")).distinct().collect()):
        some = found_links(classes.filter(F.size("v") == d), d, number, threshold)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return every.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.groupBy(F.col("a").alias("k1")).agg(F.sum("links").alias("links"))
    label = K.components(found.filter("b is not null")).withColumnRenamed("id", "k1")
    per = classes.select("k1", "k2", "rep", "w").join(links, "k1", "left").join(label, "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    name = per.groupBy("component").agg(F.min("rep").alias("component_id"))
    per = per.join(name, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = every.select("id", "k1", "k2").join(per, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
