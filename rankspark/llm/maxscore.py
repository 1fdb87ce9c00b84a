"""Ranked lexical search by MaxScore over shards of an inverted index.

index() makes the shards: every task turns the texts it reads into rows of at most SHARD_TERMS terms (a longer text is a shard
of its own), each with its documents, their sizes, and a postings list for every term (terms.py): documents of the shard in
order, with the term's occurrences. Of the texts read so far a task keeps the postings only. Nothing is dealt out by term, so a term that every document holds is spread like the texts.

search() takes the items block by block, BLOCK_PAIRS (item, term) pairs at once. Each task walks its shards and keeps every
item's k best so far; the k-th score is what a document must reach. In a shard the item's terms stand by their upper bound,
weight times the highest contribution in the shard's list. The essential ones, those at the top without which a document can't
reach the k-th score, bring candidates; the others' lists bring none and are probed for candidates only, from the highest
bound down, as long as the candidate's score and the bounds still to come can reach it. The bound that must be reached rises
with every term, as partial scores count too. Tasks return k rows an item at most; two ranked cuts merge them.

Scores: with N documents that have terms, L terms in all, n a document's, df the documents of a term, tf its occurrences,
weight = floor(1000 * ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L, and a document's score sums weight * (10^9 tf div
(1000 tf + 12m)) over the item's terms, repeats included.

Null and empty texts hold no terms: such documents are never found, such items have no rows. Items of one id are one item
with the terms of all; a null id is an id. Rows of documents that share an id are documents of their own. Equal scores stand
by ascending document id, null ids last. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import terms as T

SHARD_TERMS, SHARD_TEXTS, BLOCK_PAIRS, SALTS, PIECE = 1 << 21, 60_000, 100_000, 32, 1 << 16
NO_ID = np.iinfo(np.int64).max  # a null document id while ids are numbers
SHARD = "texts long, terms long, ids binary, sizes binary, hashes binary, counts binary, places binary, tfs binary"


def postings(first: int, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, occurrences) of some texts, by hash and document; text i has the next sizes[i] of hashes and is document first + i."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], np.repeat(np.arange(first, first + len(sizes), dtype=np.uint16), sizes)[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h))).astype(np.uint32)


def packed(ids: np.ndarray, sizes: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    """One row of the index from the postings of its texts, run after run; counts of a term in a document get as many bytes as the largest needs. Empties runs."""
    h, d, tf = (np.concatenate(x) for x in zip(*runs, strict=True))
    runs.clear()
    order = np.argsort(h, kind="stable")
    h, d, tf = h[order], d[order], tf[order].astype(np.min_scalar_type(tf.max()))
    term = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    arrays = {"ids": ids.astype("<i8"), "sizes": sizes.astype("<i8"), "hashes": h[term].astype("<u8"), "counts": np.diff(np.append(term, len(h))).astype("<i4"), "places": d.astype("<u2"), "tfs": tf.astype(tf.dtype.newbyteorder("<"))}
    return {"texts": len(ids), "terms": int(sizes.sum())} | {k: pa.py_buffer(x) for k, x in arrays.items()}


def shard(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> dict:
    """One row of the index: document i has the next sizes[i] of hashes."""
    return packed(ids, sizes, [postings(0, sizes, hashes)])


def shards_of(batches: Iterator[pa.RecordBatch], shard_terms: int = SHARD_TERMS, rows: int = K.BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The shards of batches (id, text), read `rows` texts at once, of which only the postings are kept."""
    ids, sizes, runs, n, held = [], [], [], 0, 0

    def row() -> pa.RecordBatch:
        made = packed(np.concatenate(ids), np.concatenate(sizes), runs)
        binary = lambda x: pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(x)], np.int32)), x])
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) if isinstance(x, int) else binary(x) for x in made.values()], schema=SCHEMA)

    for b in K.sliced(batches, 1, rows):
        h, _, bounds = T.terms(*K.buffers(b.column(1)))
        size = np.diff(bounds)
        has = np.flatnonzero(size)
        if len(has):
            if n and (n + len(h) > shard_terms or held + len(has) > SHARD_TEXTS):
                yield row()
                ids, sizes, n, held = [], [], 0, 0
            ids.append(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)[has])
            sizes.append(size[has])
            runs.append(postings(held, size[has], h))
            n, held = n + len(h), held + len(has)
    if n:
        yield row()


def index(docs: DataFrame, doc: str, text: str, shard_terms: int = SHARD_TERMS, rows: int = K.BATCH_ROWS) -> DataFrame:
    """The shards of all texts, read `rows` texts at once, written to the shared folder."""
    K.small_batches(docs.sparkSession)
    return K.cut(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(lambda batches: shards_of(batches, shard_terms, rows), SHARD))


SCHEMA = pa.schema([(c, pa.int64() if t == "long" else pa.binary()) for c, t in (x.split() for x in SHARD.split(", "))])


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, hash, times) of every item's terms."""
    kind = dict(items.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 1):
            h, _, bounds = T.terms(*K.buffers(b.column(1)))
            whose = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whose)), pa.array(h.view(np.int64))], names=["item", "hash"])

    found = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"item {kind}, hash long")
    return found.groupBy("item", "hash").agg(F.count(F.lit(1)).alias("times"))


def document_counts(shards: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """The documents that hold each of the wanted hashes, which ascend; at most so many rows are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column(0), b.column(1), strict=True):
                h, c = np.frombuffer(h.as_py(), "<u8"), np.frombuffer(c.as_py(), "<i4")
                at = np.minimum(np.searchsorted(h, wanted), len(h) - 1)
                there = h[at] == wanted
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(there)), pa.array(c[at[there]].astype(np.int64))], names=["term", "n"])

    got = shards.select("hashes", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(wanted), np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


class Best:
    """Every item's k best (score, id) so far."""

    def __init__(self, items: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * items, [np.zeros(0, np.int64)] * items

    def bar(self, item: int) -> int:
        """What a document's score must reach: the k-th score, as an equal one may have the smaller id; 1 before there are k."""
        s = self.scores[item]
        return int(s[-1]) if len(s) == self.k else 1

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate((self.scores[item], scores)), np.concatenate((self.ids[item], ids))
        order = np.lexsort((d, -s))[: self.k]
        self.scores[item], self.ids[item] = s[order], d[order]


def search_shard(row: dict, wanted: np.ndarray, weights: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], n_all: int, l_all: int, best: Best) -> tuple[int, int]:
    """Takes a shard's documents into best; (postings read or probed, postings of all the items' terms).

    items: for each, (places in wanted, times). wanted: ascending hashes with their weights.
    """
    hashes, counts = np.frombuffer(row["hashes"], "<u8"), np.frombuffer(row["counts"], "<i4").astype(np.int64)
    places, ids, sizes = np.frombuffer(row["places"], "<u2"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
    tfs = np.frombuffer(row["tfs"], f"<u{len(row['tfs']) // len(places)}")
    first = np.cumsum(counts) - counts
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    there = np.flatnonzero(hashes[at] == wanted)
    slot = np.full(len(wanted), -1)
    slot[there] = np.arange(len(there))
    n = counts[at[there]]
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    m = 75 + (25 * sizes * n_all) // l_all if sizes.max() < (1 << 62) // max(1, 25 * n_all) else np.array([75 + 25 * int(x) * n_all // l_all for x in sizes])
    d, gain = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    for a in range(0, len(d), PIECE):
        b = min(a + PIECE, len(d))
        lists = slice(np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b))
        own = np.minimum(bounds[1:][lists], b) - np.maximum(bounds[:-1][lists], a)
        take = np.repeat((first[at[there]] - bounds[:-1])[lists], own) + np.arange(a, b)
        d[a:b], tf = places[take], tfs[take].astype(np.int64)
        gain[a:b] = (10**9 * tf) // (1000 * tf + 12 * m[d[a:b]]) * np.repeat(weights[there][lists], own)
    top = np.maximum.reduceat(gain, bounds[:-1]) if len(there) else np.zeros(0, np.int64)
    acc, read, whole = np.zeros(len(ids), np.int64), 0, 0
    for item, (terms, times) in enumerate(items):
        here = slot[terms] >= 0
        s, times = slot[terms][here], times[here]
        bound = top[s] * times
        order = np.argsort(-bound, kind="stable")
        s, times = s[order], times[order]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from this one on can still add
        bar, j = best.bar(item), 0
        acc[:] = 0
        whole += int(n[s].sum())
        while j < len(s) and rest[j] >= bar:  # essential
            a, b = bounds[s[j]], bounds[s[j] + 1]
            acc[d[a:b]] += gain[a:b] * times[j]
            read += int(b - a)
            j += 1
            if len(acc) >= best.k and rest[j] >= bar:
                bar = max(bar, int(np.partition(acc, len(acc) - best.k)[len(acc) - best.k]))
        some = np.flatnonzero((acc > 0) & (acc + rest[j] >= bar))
        while j < len(s) and len(some):  # probed for candidates only
            a, b = bounds[s[j]], bounds[s[j] + 1]
            list_ = d[a:b]
            p = np.minimum(np.searchsorted(list_, some), len(list_) - 1)
            hit = list_[p] == some
            acc[some[hit]] += gain[a:b][p[hit]] * times[j]
            read += len(some)
            j += 1
            if len(some) > best.k:
                bar = max(bar, int(np.partition(acc[some], len(some) - best.k)[len(some) - best.k]))
            some = some[acc[some] + rest[j] >= bar]
        if len(some):
            best.add(item, acc[some], ids[some])
    return read, whole


def search_block(shards: DataFrame, pairs: pa.Table, n_all: int, l_all: int, k: int, kind: str) -> DataFrame:
    """(item, doc, score): the k best of each task's shards for the block's items."""
    names = pairs.column("item").combine_chunks()
    names = names if isinstance(names, pa.Array) else pa.concat_arrays(names.chunks)
    coded = names.dictionary_encode(null_encoding="encode")
    own, whose = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    hashes, times = pairs.column("hash").to_numpy().view(np.uint64), pairs.column("times").to_numpy()
    wanted, term = np.unique(hashes, return_inverse=True)
    df = document_counts(shards, wanted)
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    order = np.argsort(whose, kind="stable")
    cuts = np.searchsorted(whose[order], np.arange(len(own) + 1))
    items = [(term[order[a:b]], times[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: x[i].as_buffer() for c, x in zip(b.schema.names, b.columns, strict=True) if pa.types.is_binary(x.type)}
                search_shard(row, wanted, weights, items, n_all, l_all, best)
        for at in range(0, len(items), 1_000):
            sizes = [len(s) for s in best.scores[at : at + 1_000]]
            ids = np.concatenate(best.ids[at : at + 1_000])
            yield pa.RecordBatch.from_arrays([own.take(pa.array(np.repeat(np.arange(at, at + len(sizes)), sizes))), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate(best.scores[at : at + 1_000]))], names=["item", "doc", "score"])

    return shards.mapInArrow(run, f"item {kind}, doc long, score long")


def search(shards: DataFrame, items: DataFrame, item: str, text: str, k: int) -> DataFrame:
    """(item, rank, doc, score): each item's k best documents with a score above 0."""
    K.small_batches(items.sparkSession)
    kind = dict(items.dtypes)[item]
    empty = items.sparkSession.createDataFrame([], f"item {kind}, doc long, score long")
    n_all, l_all = shards.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    pairs = K.cut(item_terms(items, item, text))
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    found = None
    for block in range(blocks if n_all else 0):
        some = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()  # a block of the stated queries
        if some.num_rows:
            got = K.cut(search_block(shards, some, n_all, l_all, k, kind))
            found = got if found is None else found.unionByName(got)
    found = empty if found is None else found
    by = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc", "score"), F.lit(SALTS))
    part = found.withColumn("_salt", salt).withColumn("_r", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*by))).filter(F.col("_r") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= k).select("item", "rank", "doc", "score")
