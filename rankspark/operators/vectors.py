"""Exact vector ranking by cosine for a stated query set.

topk() works on blocks of up to BLOCK vectors, whose products are matrix products in Arrow tasks. Vectors lie in clusters around
CENTRES of themselves, sampled by hash; a cluster knows its radius, the widest angle to its centre. A query first meets the
cluster whose centre is nearest, which gives it a k-th score to beat; then only clusters in which, by centre and radius, an
equal or better score is possible: cos(max(0, angle to the centre - radius)). So the result is exact, whatever the clusters are.

Vectors that are null, empty, zero or hold null or non-finite numbers take no part, as query or as document; vectors of
different lengths have no cosine, so lengths are searched one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..sources.scratch import cut

CENTRES, ROWS_A_CENTRE, BLOCK, SLACK = 1_024, 4_096, 1_024, 1e-8  # scores are rounded to 9 digits


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """Lists of one length as rows of length 1; squares neither overflow nor vanish."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(base: DataFrame, size: int, rows: int = ROWS_A_CENTRE, most: int = CENTRES) -> np.ndarray:
    """At most `most` unit vectors of that length, those of the smallest hash: one for so many rows."""
    n = min(most, max(1, base.count() // rows))
    some = base.orderBy(F.xxhash64(F.col("id"), "v"), "id").limit(n).select("v").toArrow()  # `most` rows
    return unit_rows(some.column(0).combine_chunks(), size)


def clustered(rows: DataFrame, around: np.ndarray) -> DataFrame:
    """(cluster, reach, id, x): usable rows (id, v) of one length in their nearest cluster, the cosine to its centre, the unit vector's bytes."""
    size, kind = around.shape[1], dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                c = b.slice(at, BLOCK)
                x = unit_rows(c.column(1), size)
                near = x @ around.T
                best = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(near[np.arange(len(x)), best]), c.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["cluster", "reach", "id", "x"])

    return cut(rows.mapInArrow(run, f"cluster int, reach double, id {kind}, x binary"))


def blocks(rows: DataFrame, by: list[str], size: int = BLOCK) -> DataFrame:
    """(by, ids, xs): rows in blocks of about `size` of one group; a group of any size is many blocks."""
    n = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    placed = rows.join(F.broadcast(n), by)  # as many rows as clusters
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return placed.groupBy(*by, "part").agg(F.collect_list(F.struct("id", "x")).alias("r")).select(*by, F.col("r.id").alias("ids"), F.col("r.x").alias("xs"))


def products(pairs: DataFrame, size: int, k: int, digits: int, kind: str) -> DataFrame:
    """(item, doc, score): for every joined pair of blocks (qids, qxs, ids, xs) each query's k best."""

    def matrix(column: pa.Array, i: int) -> np.ndarray:
        return np.frombuffer(b"".join(column[i].values.to_pylist()), np.float64).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, x = matrix(b.column(1), i), matrix(b.column(3), i)
                items, docs = b.column(0)[i].values, b.column(2)[i].values
                score = np.round(q @ x.T, digits)
                own = np.array(items.to_pylist(), object)[:, None] == np.array(docs.to_pylist(), object)[None, :]
                score[own] = -np.inf
                bar = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else np.full(len(q), -np.inf)
                a, c = np.nonzero((score >= bar[:, None]) & np.isfinite(score))  # equal scores all stay: their ids decide
                yield pa.RecordBatch.from_arrays([items.take(pa.array(a)), docs.take(pa.array(c)), pa.array(score[a, c])], names=["item", "doc", "score"])

    return pairs.select("qids", "qxs", "ids", "xs").mapInArrow(run, f"item {kind}, doc {kind}, score double")


def best(rows: DataFrame, k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc")))
    return rows.withColumn("rank", at.cast("long")).filter(F.col("rank") <= k)


def reachable(queries: DataFrame, around: np.ndarray, radius: np.ndarray) -> DataFrame:
    """(id, x, cluster, bound) of every query (id, x) and cluster: no vector of the cluster has a higher cosine."""
    kind, size = dict(queries.dtypes)["id"], around.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                c = b.slice(at, 64)
                x = np.frombuffer(b"".join(c.column(1).to_pylist()), np.float64).reshape(-1, size)
                angle = np.arccos(np.clip(x @ around.T, -1, 1)) - radius
                bound = np.where(radius < 0, -2.0, np.cos(np.clip(angle, 0, np.pi)))
                row, col = np.nonzero(bound > -2)
                bars = c.column(2).to_numpy(zero_copy_only=False)
                ok = ~(bound[row, col] + SLACK < np.where(np.isnan(bars), -2, bars)[row])
                row, col = row[ok], col[ok]
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(row)), c.column(1).take(pa.array(row)), pa.array(col.astype(np.int32)), pa.array(bound[row, col])], names=["id", "x", "cluster", "bound"])

    return queries.select("id", "x", F.col("bar").cast("double").alias("bar")).mapInArrow(run, f"id {kind}, x binary, cluster int, bound double")


def topk_of_length(queries: DataFrame, base: DataFrame, size: int, k: int, digits: int, rows: int = ROWS_A_CENTRE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked, looked at, clusters) for usable vectors (id, v) of one length; looked at: (id, cluster) pairs that were scored in full."""
    around = centres(base, size, rows)
    kind = dict(base.dtypes)["id"]
    placed, asked = clustered(base, around), clustered(queries, around)
    clusters = (placed.groupBy("cluster").agg(F.min("reach").alias("reach"), F.count(F.lit(1)).alias("n")))
    docs = cut(blocks(placed.select("cluster", "id", "x"), ["cluster"]))

    def meet(q: DataFrame) -> DataFrame:
        own = blocks(q.select("cluster", "id", "x"), ["cluster"]).select("cluster", F.col("ids").alias("qids"), F.col("xs").alias("qxs"))
        return best(products(docs.join(own, "cluster"), size, k, digits, kind), k)

    if len(around) == 1:
        return meet(asked), asked.select("id", "cluster"), clusters
    first = cut(meet(asked))
    radius = np.full(len(around), -1.0)
    for r in clusters.collect():  # CENTRES rows at most
        radius[r["cluster"]] = np.arccos(np.clip(r["reach"], -1, 1)) + 1e-7
    bars = first.groupBy("item").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select(F.col("item").alias("id"), "bar")
    further = cut(reachable(asked.join(bars, "id", "left").select("id", "x", "bar"), around, radius).join(asked.select("id", F.col("cluster").alias("own")), "id").filter("cluster <> own").select("id", "x", "cluster"))
    out = best(first.select("item", "doc", "score").unionByName(meet(further).select("item", "doc", "score")), k)
    return out, further.select("id", "cluster").unionByName(asked.select("id", "cluster")), clusters


def topk(queries: DataFrame, base: DataFrame, k: int, digits: int = 9, rows: int = ROWS_A_CENTRE) -> DataFrame:
    """(item, doc, score, rank): each query's k nearest other vectors, equal scores by id. queries: item, qv; base: doc, v; ids are distinct."""
    usable = lambda df, i, v: df.select(F.col(i).alias("id"), F.col(v).cast("array<double>").alias("v")).filter(S.usable_vector(F.col("v")))
    q, b = usable(queries, "item", "qv"), usable(base, "doc", "v")
    out = None
    for (size,) in sorted(tuple(r) for r in q.select(F.size("v")).distinct().collect()):
        same = lambda df: df.filter(F.size("v") == size)  # noqa: B023, E731
        if same(b).isEmpty():
            continue
        got = topk_of_length(same(q), same(b), size, k, digits, rows)[0]
        out = got if out is None else out.unionByName(got)
    kind = dict(b.dtypes)["id"]
    return b.sparkSession.createDataFrame([], f"item {kind}, doc {kind}, score double, rank long") if out is None else out


def looked_at(queries: DataFrame, base: DataFrame, k: int, size: int, digits: int = 9, rows: int = ROWS_A_CENTRE) -> tuple[int, int]:
    """(vectors scored for all queries, vectors times queries): the share that bounds don't save."""
    q, b = (df.select(F.col(i).alias("id"), F.col(v).cast("array<double>").alias("v")).filter(S.usable_vector(F.col(v)) & (F.size(v) == size)) for df, i, v in ((queries, "item", "qv"), (base, "doc", "v")))
    _, pairs, clusters = topk_of_length(q, b, size, k, digits, rows)
    return pairs.join(clusters, "cluster").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], q.count() * b.count()


def first_ranks(queries: DataFrame, base: DataFrame, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """(item, first_rank, n): each query's rank of its best vector of the same label among all n others, equal scores by id.

    queries: item, qv, own; base: doc, v, label; ids are distinct whole numbers. Every pair of blocks is multiplied twice: for the
    best of the label, then to count what is ahead of it. The work is that of all pairs; a task holds two blocks and their product.
    """
    def usable(df: DataFrame, i: str, v: str, label: str) -> DataFrame:
        return df.select(F.col(i).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label")).filter(S.usable_vector(F.col("v")))

    def in_blocks(rows: DataFrame, *more: str) -> DataFrame:
        parts = max(1, -(-rows.count() // block))
        names = ["id", "x", "label", *more]
        placed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(*names)).alias("r"))  # `block` rows or so
        spread_out = placed.repartition(min(parts, 4 * rows.sparkSession.sparkContext.defaultParallelism), "part")
        return cut(spread_out.select(*[F.col(f"r.{c}").alias(c) for c in names]))

    def units(rows: DataFrame, size: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = unit_rows(b.column(1), size)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2)], names=["id", "x", "label"])

        return cut(rows.mapInArrow(run, "id long, x binary, label string"))

    def met(q: DataFrame, docs: DataFrame, size: int, schema: str, judge: Callable) -> DataFrame:
        def matrix(cell: pa.ListScalar) -> np.ndarray:
            return np.frombuffer(b"".join(cell.values.to_pylist()), np.float64).reshape(-1, size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    row = {name: b.column(n)[i] for n, name in enumerate(b.schema.names)}
                    score = np.round(matrix(row["qx"]) @ matrix(row["x"]).T, digits)
                    items, docs = (row[c].values.to_numpy(zero_copy_only=False) for c in ("qid", "id"))
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in judge(score, items, docs, row)], names=[c.split()[0] for c in schema.split(", ")])

        asked = q.withColumnsRenamed({"id": "qid", "x": "qx", "label": "own"})
        return docs.crossJoin(asked).mapInArrow(run, schema)  # broadcast or cartesian, by size

    def best_of_label(score: np.ndarray, items: np.ndarray, docs: np.ndarray, row: dict) -> tuple:
        codes = pa.concat_arrays([row["own"].values, row["label"].values]).dictionary_encode().indices
        codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
        own, label = codes[: len(items)], codes[len(items) :]
        good = (own[:, None] == label[None, :]) & (own[:, None] >= 0) & (items[:, None] != docs[None, :])
        top = np.where(good, score, -np.inf).max(axis=1)
        doc = np.where(good & (score == top[:, None]), docs[None, :], np.iinfo(np.int64).max).min(axis=1)
        found = np.isfinite(top)
        return items[found], top[found], doc[found]

    def ahead_of_best(score: np.ndarray, items: np.ndarray, docs: np.ndarray, row: dict) -> tuple:
        top, first = (row[c].values.to_numpy(zero_copy_only=False)[:, None] for c in ("best_score", "best_doc"))
        other = (items[:, None] != docs[None, :])
        ahead = other & (docs[None, :] != first) & ((score > top) | ((score == top) & (docs[None, :] < first)))
        return items, ahead.sum(axis=1), other.sum(axis=1)

    q, b = usable(queries, "item", "qv", "own"), usable(base, "doc", "v", "label")
    out = None
    for (size,) in sorted(tuple(r) for r in q.select(F.size("v")).distinct().collect()):
        same = lambda df: units(df.filter(F.size("v") == size), size)  # noqa: B023, E731
        asked, docs = same(q), in_blocks(same(b))
        top = met(in_blocks(asked), docs, size, "item long, score double, doc long", best_of_label)
        top = top.groupBy("item").agg(F.max(F.struct("score", (-F.col("doc")).alias("neg"))).alias("b")).select(F.col("item").alias("id"), F.col("b.score").alias("best_score"), (-F.col("b.neg")).alias("best_doc"))
        told = in_blocks(asked.join(cut(top), "id"), "best_score", "best_doc")
        got = met(told, docs, size, "item long, ahead long, n long", ahead_of_best).groupBy("item").agg((F.sum("ahead") + 1).alias("first_rank"), F.sum("n").alias("n"))
        out = got if out is None else out.unionByName(got)
    return b.sparkSession.createDataFrame([], "item long, first_rank long, n long") if out is None else out
