"""Vector code compression: product codebooks kept by delta-maintained Lloyd rounds, in whole numbers.

Every component x becomes floor(256 x); a vector is cut into PARTS consecutive parts, and each part position has a codebook
whose first entries are that part of the ENTRIES smallest ids' vectors. A round assigns every part to the nearest entry
(squared Euclidean distance, ties to the lower index) and replaces each entry by the componentwise floor of its parts' mean;
entries without parts stay. After the rounds all parts are assigned once more.

The written state is the vectors with their codes and, for each part position and entry, the count and the sums of its parts.
A round reads the vectors with their previous codes and writes them with the new ones, without a shuffle. Beside the codes, a
task writes what has changed, added up: the parts that left an entry as minus, those that came as plus. Only these rows, at
most one for each position and entry and batch, are shuffled, to be added to the sums before. In the first round all parts
come. So the sums stay exact, and a round in which little moves shuffles little.

Rows whose vector is null or holds null or non-finite numbers are dropped. Vectors of each length have codebooks of their own.
Where PARTS doesn't divide a length the first parts have one number more; parts of no number get code 0. Numbers beyond what
lets squared distances fit 64 bits (with 64 components: |x| of 2^18) count as that bound. Rows of one id are coded each; the
first codebook takes equal ids by the bytes of their vectors, null ids last. Equal labels share label_error, nulls together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

PARTS, ENTRIES, ROUNDS, SCALE, BATCH = 16, 64, 2, 256.0, 4_096
BROADCAST_LABELS = 10_000
DELTA = "array<struct<size:int,part:int,entry:int,n:bigint,sums:array<bigint>>>"


def cuts(size: int, parts: int = PARTS) -> np.ndarray:
    """Where the parts of vectors of this length begin, and the length."""
    return np.concatenate(([0], np.cumsum([size // parts + (p < size % parts) for p in range(parts)])))


def bound(size: int) -> int:
    """The largest component for which `size` squared differences add up to less than 2^62."""
    return (1 << ((62 - max(1, size).bit_length()) // 2 - 1)) - 1


def whole(column: pa.Array, size: int) -> np.ndarray:
    """The components of lists of one length as whole numbers."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)
    most = bound(size)
    return np.clip(np.floor(np.clip(x, -most, most) * SCALE), -most, most).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each row's nearest entry, its squared distance); ties to the lower index."""
    if x.shape[1] == 0:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 52:  # doubles hold these sums exactly
        a, e = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ e.T) + (e * e).sum(axis=1)
        best = d.argmin(axis=1)
        return best, d[np.arange(len(x)), best].astype(np.int64)
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for i, e in enumerate(entries):
        d = ((x - e) ** 2).sum(axis=1)
        closer = d < least
        best[closer], least[closer] = i, d[closer]
    return best, least


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes rows x parts, error of each row)."""
    at = cuts(x.shape[1], len(books))
    found = [nearest(x[:, a:b], e) for a, b, e in zip(at[:-1], at[1:], books, strict=True)]
    return np.stack([f[0] for f in found], 1).astype(np.uint8), sum(f[1] for f in found)


def deltas(x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> list[dict]:
    """Plus and minus contributions of the parts whose code changed, added up by position and entry."""
    size, out = x.shape[1], []
    at = cuts(size, new.shape[1])
    for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        moved = np.flatnonzero(new[:, p] != old[:, p]) if old is not None else np.arange(len(x))
        n, sums = np.zeros(ENTRIES, np.int64), np.zeros((ENTRIES, b - a), np.int64)
        for sign, codes in ((1, new), (-1, old)):
            if codes is not None:
                np.add.at(n, codes[moved, p], sign)
                np.add.at(sums, codes[moved, p], sign * x[moved, a:b])
        touched = np.zeros(ENTRIES, bool)
        touched[new[moved, p]] = True
        if old is not None:
            touched[old[moved, p]] = True
        out += [{"size": size, "part": p, "entry": int(e), "n": int(n[e]), "sums": sums[e].tolist()} for e in np.flatnonzero(touched)]
    return out


def prepared(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, size, x): usable rows, components as whole numbers."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(v.isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.size(v).alias("size"), v.alias("v"))
    kind = dict(kept.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                c = b.slice(at, BATCH)
                sizes = c.column(2).to_numpy()
                for size in np.unique(sizes).tolist():  # nearly always one
                    own = c if (sizes == size).all() else c.filter(pa.array(sizes == size))
                    x = pa.array([r.tobytes() for r in whole(own.column(3), size)], pa.binary())
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), x], names=["id", "label", "size", "x"])

    return K.cut(kept.mapInArrow(run, f"id long, label {kind}, size int, x binary"))


def first_books(state: DataFrame, parts: int = PARTS) -> dict[int, list[np.ndarray]]:
    """By vector length, each position's first entries: ENTRIES rows a length at most are collected."""
    out = {}
    for size in sorted(r[0] for r in state.select("size").distinct().collect()):
        some = state.filter(F.col("size") == size).orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
        x = np.array([np.frombuffer(r[0], np.int64) for r in some]).reshape(len(some), size)
        at = cuts(size, parts)
        out[size] = [x[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def coded(state: DataFrame, books: dict[int, list[np.ndarray]], last: bool) -> DataFrame:
    """The state with new codes and, unless last, what changed; else with each row's error."""
    has_code, shas = "code" in state.columns, {size: digest(each) for size, each in books.items()} if last else {}
    kind = dict(state.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BATCH):
                c = b.slice(start, BATCH)
                sizes = c.column(2).to_numpy()
                for size in np.unique(sizes).tolist():
                    own = c if (sizes == size).all() else c.filter(pa.array(sizes == size))
                    x = np.frombuffer(K.raw(own.column(3))[0].tobytes(), np.int64).reshape(-1, size) if size else np.zeros((own.num_rows, 0), np.int64)
                    codes, error = assign(x, books[size])
                    code = pa.array([r.tobytes() for r in codes], pa.binary())
                    if last:
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(error), pa.array([shas[size]] * own.num_rows, pa.string())], names=["id", "label", "code", "error", "sha"])
                        continue
                    old = np.frombuffer(K.raw(own.column(4))[0].tobytes(), np.uint8).reshape(codes.shape) if has_code else None
                    changed = pa.array([deltas(x, old, codes), *[None] * (own.num_rows - 1)], pa.list_(pa.struct([("size", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))
                    yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(4)), code, changed], names=["id", "label", "size", "x", "code", "changed"])

    read = state.select("id", "label", "size", "x", *(["code"] if has_code else []))
    return read.mapInArrow(run, f"id long, label {kind}, code string, error long, sha string" if last else f"id long, label {kind}, size int, x binary, code binary, changed {DELTA}")


def added(state: DataFrame, sums: DataFrame | None) -> DataFrame:
    """The running sums (size, part, entry, place, n, total) with what the state's round changed."""
    d = state.filter(F.col("changed").isNotNull()).select(F.explode("changed").alias("d")).select("d.*")
    each = d.select("size", "part", "entry", "n", F.posexplode_outer("sums").alias("place", "total"))
    each = each if sums is None else each.unionByName(sums)
    return K.cut(each.groupBy("size", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))


def moved(books: dict[int, list[np.ndarray]], sums: DataFrame) -> dict[int, list[np.ndarray]]:
    """The entries at the floor of their parts' mean; 64 numbers a component are collected."""
    out = {size: [e.copy() for e in each] for size, each in books.items()}
    for r in sums.filter("n > 0 and total is not null").collect():
        out[r["size"]][r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for e in books for v in e.ravel()).encode()).hexdigest()


def train(rows: DataFrame, key: str, vector: str, label: str, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, list[np.ndarray]], DataFrame | None]:
    """(state with codes, codebooks by length, running sums) after the rounds."""
    state = prepared(rows, key, vector, label)
    books, sums = first_books(state), None
    for _ in range(rounds if books else 0):
        old, before = state, sums
        state = K.cut(coded(old, books, False))
        sums = added(state, before)
        books = moved(books, sums)
        K.drop_cut(old, *([] if before is None else [before]))
    return state, books, sums


def compressed(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable row."""
    state, books, _ = train(rows, key, vector, label, rounds)
    done = K.cut(coded(state, books, True).withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    K.drop_cut(state)
    totals = K.cut(done.groupBy("of").agg(F.sum("error").alias("label_error")))
    out = done.join(F.broadcast(totals), "of") if totals.count() <= BROADCAST_LABELS else K.join_hot(done, totals, "of", "id")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.col("sha").alias("codebooks_sha256"))
