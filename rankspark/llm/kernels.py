"""Shared array kernels and job helpers.

Texts are read as the UTF-8 buffers of Arrow columns; words, shingles and their hashes come from whole-array operations,
so a document is never handled word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, cut_mark, cuts_since, drop_cut, shared_folder  # noqa: F401

BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
HOT_SHARE, SALTS = 1_000, 256
PIECE = 1 << 19  # bytes handled at once; longer texts go piece by piece, cut at white space
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = 0x9E3779B97F4A7C15 | 1
STEP_INV = pow(STEP, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse; workers keep those of pieces, not those of a longer word or text."""
    if len(_POWERS.get("up", ())) >= n:
        return _POWERS["up"], _POWERS["down"]
    out = []
    with np.errstate(over="ignore"):
        for base in (STEP, STEP_INV):
            p = np.full(max(n, 2 * PIECE), base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p, out=p))
    if n <= 2 * PIECE:
        _POWERS["up"], _POWERS["down"] = out
    return out[0], out[1]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    return raw(column.cast(pa.large_string()).fill_null(""))


def _words_of_piece(data: np.ndarray, cuts: np.ndarray, fold: bool, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a piece; no word crosses a cut."""
    inside = ~breaks[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends_at = cuts[(cuts > 0) & (cuts <= len(data))] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[LOWER[data] if fold else data] * up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return starts, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, bounds): 64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, their byte offsets; document i has words bounds[i]:bounds[i+1].

    fold: A-Z as a-z. breaks: the bytes that part words, white space unless given. A word longer than a piece makes its piece longer; nothing else does.
    """
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:  # cut after white space or at a document's start
            spaces = np.flatnonzero(breaks[data[at:end]])
            k = np.searchsorted(offsets, end, "right") - 1
            if offsets[k] > at or len(spaces):
                end = max(int(offsets[k]) if offsets[k] > at else 0, at + int(spaces[-1]) + 1 if len(spaces) else 0)
            else:
                rest = data[end : int(offsets[k + 1])]
                more = np.flatnonzero(breaks[rest])
                end += int(more[0]) + 1 if len(more) else len(rest)
        lo, hi = np.searchsorted(offsets, [at, end])
        s, h = _words_of_piece(data[at:end], np.unique(offsets[lo : hi + 1]) - at, fold, breaks)
        starts.append(s + at)
        hashes.append(h)
        at = end
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return h, s, np.searchsorted(s, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    data, offsets = buffers(column)
    h, _, bounds = words(data, offsets)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            s = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                s += h[j : len(h) - k + 1 + j] * np.uint64((STEP * (2 * j + 3)) % (1 << 64))
            s = mix(s)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                short = np.uint64(b - a) * np.uint64(0xA0761D6478BD642F)
                for j in range(b - a):
                    short = mix(short + h[a + j] * np.uint64((STEP * (2 * j + 3)) % (1 << 64)))
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def hash_text(s: str) -> int:
    """The hash that words() gives to one word (unfolded)."""
    raw = np.frombuffer(s.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]), False)[0][0]) if len(raw) else 0


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch; row counts stay as they are. sliced() does the rest."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], text: int, rows: int = BATCH_ROWS, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of at most `rows` rows and `size` bytes of the column numbered `text`; a longer text is a run of its own."""
    for b in batches:
        total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        at = 0
        while at < b.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1), b.num_rows)
            yield b.slice(at, end - at)
            at = end


def join_hot(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join of rows with a table of few rows a key, in which no key is one task.

    Keys that more than one in HOT_SHARE of all rows hold are hot: fewer than HOT_SHARE keys, so they can be named in the plan.
    Their rows are dealt over SALTS parts by the column `spread`, and the table's rows repeated for each part. rows must be
    cheap to read and have no null keys.
    """
    least = max(HOT_SHARE, rows.count() // HOT_SHARE)
    hot = [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(key).collect()]  # fewer than HOT_SHARE keys
    if not hot:
        return rows.join(table, key)
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    is_hot, none = F.col(key).isin(hot), F.lit(0).cast("long")
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS).cast("long"))).otherwise(none))
    return dealt.join(table.withColumn("_salt", F.explode(F.when(is_hot, salts).otherwise(F.array(none)))), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) of undirected edges: the smallest id reachable, by alternating large and small stars.

    Every round is a pair of grouped minima and joins on written tables; hubs are aggregated map-side before any shuffle, and
    as the minima are written before they are joined, both sides of a join are dealt out for it and a hub's part can be split.
    Ids without an edge have no row. Null ends are ignored.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = cut(edges.filter(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.filter("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        row = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_cut(e, first, large, least)
        e = new
        if state == tuple(row):
            break
        state = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
