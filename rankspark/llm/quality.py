"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector for all grades and ordered thresholds t_1 < t_2 < ... (kept in
order by summing exponentials). x marks which of the text's words and word pairs occur, lower-cased and hashed into DIM slots,
and which tenth its share of words said twice in a row falls into. Marks, not shares of the text: one telling word counts as
much in a long text as in a short one. Only slots whose presence differs between lower and higher
grades by EVIDENCE standard errors get a weight, so rare words that one grade has by chance say nothing. The expected grade is
the sum of the tail probabilities; a document is selected if its tail probability at SELECT_GRADE is at least SELECT_AT.

Grades of the labels: 0 toxic, 1 neither good nor toxic, 2 good. The model is fitted on the driver on at most SAMPLE labelled
documents, those of the smallest hash of their id: the documented bound, whatever the length of their texts. Tasks read the
texts; the driver gets the slots of each, as a list or as DIM bits, whichever is shorter. Scoring reads every whole text.
Null and empty texts have no features: expected grade and tail follow from the thresholds alone. Without labels, or with
labels of one grade only, every document has a null grade and is selected. Labels that contradict each other count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

DIM, GRADES, SAMPLE = 1 << 18, 3, 6_000
STEPS, RATE, DECAY, EVIDENCE = 200, 0.05, 1e-4, 4.5
SELECT_GRADE, SELECT_AT = 2, 0.5


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the slots that occur."""
    data, offsets = K.buffers(column)
    h, _, bounds = K.words(data, offsets)
    with np.errstate(over="ignore"):
        one = (h % np.uint64(DIM)).astype(np.int64)
        two = (K.mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(DIM)).astype(np.int64) if len(h) else one
    twice = np.concatenate(([0], np.cumsum(h[1:] == h[:-1]))) if len(h) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            words = np.unique(one[a:b])
            tenth = np.array([10 * (twice[b - 1] - twice[a]) // (b - a)], np.uint64)
            shape = (K.mix(tenth + np.uint64(DIM)) % np.uint64(DIM)).astype(np.int64)
            slots = np.unique(np.concatenate((words, two[a : b - 1], shape)))
            yield slots
        else:
            yield np.zeros(0, np.int64)


def packed(slots: np.ndarray) -> bytes:
    if len(slots) * 32 < DIM:
        return slots.astype("<i4").tobytes()
    bits = np.zeros(DIM, bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4").astype(np.int64) if len(raw) < DIM // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


def telling(slots: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Whether each slot's presence differs between the grades below and from k on, for some k, by EVIDENCE standard errors."""
    n, by_grade, out = len(grades), np.zeros((GRADES, DIM)), np.zeros(DIM, bool)
    for s, g in zip(slots, grades.tolist(), strict=True):
        by_grade[g, s] += 1
    total = by_grade.sum(axis=0)
    for k in range(1, GRADES):
        high = int((grades >= k).sum())
        if 0 < high < n:
            up = by_grade[k:].sum(axis=0)
            share = (total + 1) / (n + 2)
            error = np.sqrt(share * (1 - share) * (1 / high + 1 / (n - high)))
            out |= np.abs(up / high - (total - up) / (n - high)) >= EVIDENCE * error
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered: the first as it is, then positive steps."""
    return np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))


def loss(w: np.ndarray, raw: np.ndarray, r: np.ndarray, c: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(weighted negative log-likelihood and decay, its gradient by w, by raw); text r[i] holds slot c[i]."""
    n, t = len(grades), thresholds(raw)
    z = np.bincount(r, w[c], n)
    upper = np.concatenate((np.ones((n, 1)), _sigmoid(z[:, None] - t), np.zeros((n, 1))), 1)  # P(grade >= k), k = 0..GRADES
    a, b = upper[np.arange(n), grades], upper[np.arange(n), grades + 1]
    p = np.maximum(a - b, 1e-9)
    da, db = a * (1 - a), b * (1 - b)
    dz = -weight * (da - db) / p
    dt = np.array([(weight * ((grades == k + 1) * da - (grades == k) * db) / p).sum() for k in range(GRADES - 1)])
    draw = np.array([dt.sum(), *[dt[k:].sum() * np.exp(raw[k]) for k in range(1, GRADES - 1)]])
    return float(-(weight * np.log(p)).sum() + DECAY / 2 * (w @ w)), np.bincount(c, dz[r], DIM) + DECAY * w, draw


def fit(slots: list[np.ndarray], grades: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights, thresholds) by Adam on the cumulative-link likelihood; grades weigh by the inverse of their share."""
    if not len(grades) or len(np.unique(grades)) < 2:
        return None
    known = telling(slots, grades)
    kept = [s[known[s]] for s in slots]
    r, c = np.repeat(np.arange(len(kept)), [len(s) for s in kept]), np.concatenate(kept)
    weight = (1 / np.maximum(np.bincount(grades, minlength=GRADES), 1))[grades]
    weight /= weight.sum()
    w, raw = np.zeros(DIM), np.concatenate(([-1.0], np.zeros(GRADES - 2)))
    m, s2 = np.zeros(DIM + GRADES - 1), np.zeros(DIM + GRADES - 1)
    for step in range(1, steps + 1):
        _, dw, draw = loss(w, raw, r, c, grades, weight)
        g = np.concatenate((dw, draw))
        m, s2 = 0.9 * m + 0.1 * g, 0.999 * s2 + 0.001 * g * g
        move = RATE * 10 * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.999**step)) + 1e-8)
        w -= move[:DIM]
        raw -= move[DIM:] * 0.1
    return w, thresholds(raw)


def training_rows(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(grade, slots) of the bounded sample: at most SAMPLE rows."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    graded = labels.filter(F.col(doc).isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull())).select(F.col(doc).alias("_id"), grade.alias("grade"), F.xxhash64(F.col(doc).cast("string"), F.lit(9)).alias("_h"))
    graded = graded.join(docs.select(F.col(doc).alias("_id")), "_id", "left_semi")  # labels of absent documents take no place
    picked = graded.orderBy("_h", "_id", "grade").limit(SAMPLE)
    joined = docs.select(F.col(doc), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), F.col(doc) == F.col("_id"))  # at most SAMPLE rows of three numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 2):
            slots = pa.array([packed(s) for s in features(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), slots], names=["h", "grade", "slots"])

    found = joined.select("_h", "grade", "text").mapInArrow(run, "h long, grade int, slots binary")
    return found.orderBy("h", "grade", "slots").limit(SAMPLE).select("grade", "slots")


def score(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, expected_grade, tail, selected)."""
    K.small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, doc, text).toArrow()
    model = fit([unpacked(x.as_py()) for x in sample.column("slots")], sample.column("grade").to_numpy().astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 1):
            if model is None:
                e = t = [None] * b.num_rows
                chosen = [True] * b.num_rows
            else:
                w, cut = model
                z = np.array([w[s].sum() for s in features(b.column(1))])
                tails = _sigmoid(z[:, None] - cut)
                e, t = tails.sum(axis=1), tails[:, SELECT_GRADE - 1]
                chosen = t >= SELECT_AT
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e, pa.float64()), pa.array(t, pa.float64()), pa.array(chosen, pa.bool_())], names=["doc", "expected_grade", "tail", "selected"])

    kind = dict(docs.dtypes)[doc]
    return docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc {kind}, expected_grade double, tail double, selected boolean")
