"""Nearest neighbours by learned partitions.

Fit, on a bounded sample: their neighbour graph (NEIGHBOURS by inner product) is cut into balanced parts by label propagation
under a capacity; a softmax classifier learns each vector's part and its neighbours' parts. Index: every row goes to its most
probable part. Search: a query goes to as many of its most probable parts as reached TARGET_RECALL on held-out sample queries,
and is compared there with every row, in double precision. A query that finds fewer than k rows there, though there are more,
is compared with every row of all parts.

Parts grow in number with the rows (PER_PART each, a power of two), and the sample with the parts (PER_SAMPLE each), from
SAMPLE to MOST_SAMPLE vectors: that bounds the parts by MOST_SAMPLE / PER_SAMPLE, beyond which they grow in size. A task takes
CELL parts with about BLOCK rows, meets CHUNK queries at a time with the parts each of them probes, and returns one list of k
best for each query, not one per part. Parts that hold more are dealt out in blocks, so a third of all rows in one part, or of
equal vectors, is many tasks. Ties go to smaller ids.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite numbers take no part. A query
never finds rows of its own id. Rows that repeat an id are found once, at their best; a query id that repeats asks once, with
the smallest of its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import vectors as V

SAMPLE, MOST_SAMPLE, PER_SAMPLE, NEIGHBOURS, PER_PART = 4_096, 32_768, 8, 10, 1_024
ROWS = 4_096  # of the sample at once: of a graph's rows, of votes, of a training step
TARGET_RECALL, BLOCK, CHUNK = 0.95, 20_000, 20_000
CELL = BLOCK // PER_PART
SEED = 3


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(x) - 1)
    if k < 1:
        return np.zeros((len(x), 0), int)
    out, step = np.zeros((len(x), k), int), max(1, ROWS * ROWS // len(x))
    for at in range(0, len(x), step):
        s = x[at : at + step] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12) -> np.ndarray:
    """A label per vector: parts of nearly equal size that keep neighbours together."""
    n, rng = len(x), np.random.default_rng(SEED)
    room = -(-n // parts)
    # start: equal slices along successive principal directions
    label = np.zeros(n, int)
    groups = [np.arange(n)]
    while len(groups) < parts:
        g = groups.pop(int(np.argmax([len(g) for g in groups])))
        y = x[g] - x[g].mean(axis=0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        order = g[np.argsort(y @ axis, kind="stable")]
        groups += [order[: len(g) // 2], order[len(g) // 2 :]]
    for i, g in enumerate(groups):
        label[g] = i
    # neighbours in both directions, by vector
    ends = np.concatenate((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()))
    others = np.concatenate((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))
    order = np.argsort(ends, kind="stable")
    ends, others = ends[order], others[order]
    for _ in range(sweeps):
        best, gain = np.zeros(n, int), np.zeros(n)
        for at in range(0, n, ROWS):
            lo, hi = np.searchsorted(ends, [at, min(at + ROWS, n)])
            own = np.arange(at, min(at + ROWS, n))
            votes = np.zeros((len(own), parts))
            np.add.at(votes, (ends[lo:hi] - at, label[others[lo:hi]]), 1.0)
            best[own] = votes.argmax(axis=1)
            gain[own] = votes.max(axis=1) - votes[np.arange(len(own)), label[own]]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain + 1e-6 * rng.random(n)):
            a, b = label[i], best[i]
            if gain[i] <= 0:
                break
            if size[b] < room * 1.05:
                label[i], moved = b, moved + 1
                size[a] -= 1
                size[b] += 1
        if not moved:
            break
    return label


def train_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, steps: int = 200) -> np.ndarray:
    """Softmax weights (d + 1, parts): the target is a vector's own part and, as much again, its neighbours' parts."""
    n, rng = len(x), np.random.default_rng(SEED)
    scale = np.sqrt((x * x).mean()) or 1.0
    w, m, s = (np.zeros((x.shape[1] + 1, parts)) for _ in range(3))
    for t in range(1, steps + 1):
        some = np.arange(n) if n <= ROWS else rng.choice(n, ROWS, replace=False)
        y = np.zeros((len(some), parts))
        y[np.arange(len(some)), label[some]] = 1.0
        if graph.shape[1]:
            np.add.at(y, (np.repeat(np.arange(len(some)), graph.shape[1]), label[graph[some].ravel()]), 1.0 / graph.shape[1])
        y /= y.sum(axis=1, keepdims=True)
        z = np.hstack([x[some] / scale, np.ones((len(some), 1))])
        a = z @ w
        p = np.exp(a - a.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = z.T @ (p - y) / len(some) + 1e-4 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    w[:-1] /= scale
    return w


def route(x: np.ndarray, w: np.ndarray, m: int) -> np.ndarray:
    """The m most probable parts of each row, best first."""
    return np.argsort(-(x @ w[:-1] + w[-1]), axis=1, kind="stable")[:, :m]


def layout(n_rows: int) -> tuple[int, int]:
    """(parts, vectors to sample for their fit)."""
    parts = 1 << int(np.clip(np.round(np.log2(max(1, n_rows / PER_PART))), 2, np.log2(MOST_SAMPLE // PER_SAMPLE)))
    return parts, int(np.clip(PER_SAMPLE * parts, SAMPLE, MOST_SAMPLE))


def fit(x: np.ndarray, parts: int, k: int) -> tuple[np.ndarray, int]:
    """(router weights, parts to probe)."""
    parts = max(1, min(parts, len(x) // PER_SAMPLE))
    held = len(x) // 8
    train, test = x[held:], x[:held]
    graph = neighbour_graph(train, NEIGHBOURS)
    w = train_router(train, graph, balanced_parts(train, graph, parts), parts)
    if not held:
        return w, parts
    top = np.argsort(-(test @ train.T), axis=1)[:, :k]
    home, asked = route(train, w, 1)[:, 0], route(test, w, parts)
    place = np.argsort(asked, axis=1)  # rank of each part for each query
    depth = np.take_along_axis(place, home[top], axis=1)
    recall = [(depth < m).mean() for m in range(1, parts + 1)]
    return w, next(m for m, r in enumerate(recall, 1) if r >= TARGET_RECALL or m == parts)


def block_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best ids of a block: score down, then id up. Sums of a pair don't depend on its place."""
    out = [[], [], []]
    k *= int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1  # repeated ids must not push others out
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[q_ids[a : a + 256][:, None] == ids[None, :]] = -np.inf
        kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        slack = 1e-9 * (1 + np.abs(kth))
        r, c = np.nonzero((s >= np.where(np.isfinite(kth), kth - slack, -np.inf)[:, None]) & np.isfinite(s))
        exact = (q[a + r] * x[c]).sum(axis=1)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, np.arange(len(s)))
        keep = np.arange(len(r)) - first[r] < k
        out[0].append(q_ids[a + r[keep]])
        out[1].append(ids[c[keep]])
        out[2].append(exact[keep])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def merged(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of two lists of (query, row, score), each id once."""
    q, ids, score = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((-score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[once], ids[once], score[once]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], score[keep]


def search(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """(query_id, rank, <key>, score): each query's k nearest rows found, by inner product. Both frames have key and vector."""
    spark = base.sparkSession
    schema = "query_id long, rank int, id long, score double"
    rows = base.filter(V.usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["id", "v"])
    asked = queries.filter(V.usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked, found = asked.groupBy("id").agg(F.min("v").alias("v")), None
    for (d,) in sorted(tuple(r) for r in asked.select(F.size("v")).distinct().collect()):  # each length by itself
        some, same = asked.filter(F.size("v") == d), rows.filter(F.size("v") == d)
        if not same.isEmpty():
            one = _search_length(same, some, d, k)
            found = one if found is None else found.unionByName(one)
    return (spark.createDataFrame([], schema) if found is None else found).withColumnRenamed("id", key)


def _search_length(rows: DataFrame, asked: DataFrame, d: int, k: int) -> DataFrame:
    """(query_id, rank, id, score) for vectors (id, v) of one length."""
    parts, size = layout(rows.count())
    w, probes = fit(V.sample(rows, "id", "v", size, d), parts, k)
    first = K.cut(_probe(rows, asked, w, probes, d, k))
    # a query that found too few, though there are more rows, asks all parts
    ids = rows.select("id").distinct()
    total = ids.count()
    need = F.least(F.lit(k), F.lit(total) - F.when(F.col("own"), 1).otherwise(0))
    wanted = asked.join(ids.withColumn("own", F.lit(True)), "id", "left").join(first.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("found")), "id", "left")
    short = K.cut(wanted.filter(F.coalesce("found", F.lit(0)) < need).select("id", "v"))
    if not short.isEmpty():
        again = _probe(rows, short, w, w.shape[1], d, k)
        first = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return first


def _probe(rows: DataFrame, asked: DataFrame, w: np.ndarray, probes: int, d: int, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query's most probable parts."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = route(V.matrix(b.column(1), d), w, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((part // CELL).astype(np.int32)), pa.array(part.astype(np.int32))], names=["id", "v", "cell", "part"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = route(V.matrix(b.column(1), d), w, probes)
            for cell in np.unique(parts // CELL):
                here = parts // CELL == cell
                some = np.flatnonzero(here.any(axis=1))
                ends = np.concatenate(([0], np.cumsum(here[some].sum(axis=1)))).astype(np.int32)
                probed = pa.ListArray.from_arrays(pa.array(ends), pa.array(parts[some][here[some]].astype(np.int32)))
                q = b.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*q.columns, pa.array(np.full(len(some), cell, np.int32)), probed], names=["id", "v", "cell", "parts"])

    placed = rows.mapInArrow(place, "id long, v array<double>, cell int, part int")
    routed = asked.mapInArrow(ask, "id long, v array<double>, cell int, parts array<int>")
    # how many blocks of rows and chunks of queries a cell makes: one small row per cell
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    chunks = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    plan = blocks.join(chunks, "cell")
    left = placed.join(plan, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "v", "part")
    right = routed.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "v", "parts")

    def best(x: pa.Table, q: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if x.num_rows and q.num_rows:
            ids, v, part = x.column("id").to_numpy(), V.matrix(x.column("v"), d), x.column("part").to_numpy()
            q_ids, asking, lists = q.column("id").to_numpy(), V.matrix(q.column("v"), d), q.column("parts").combine_chunks()
            probed, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q_ids)), lists.value_lengths().to_numpy())
            for p in np.unique(part):
                mine, rows_here = who[probed == p], np.flatnonzero(part == p)
                if len(mine):
                    found = merged(found, block_best(q_ids[mine], asking[mine], ids[rows_here], v[rows_here], k), k)
        return pa.Table.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "id", "score"])

    keys = ("cell", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, id long, score double")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
