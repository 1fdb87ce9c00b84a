"""Language identification by rank-order profiles (out-of-place distance).

A text's letters, lower-cased, with one space around each run of letters, give its character n-grams of length 1 to 3. A
profile is the list of a language's most frequent n-grams over all its training texts, by rank. A text's own list is compared
with each profile: the distance adds, for every n-gram of the text's list, how far its rank is from the profile's, or the
profile's length if it isn't there. The nearest language wins, ties by code point order.

Null texts and texts without a letter are `und` with score 0; so are all texts if nothing was learned. Whole texts count.
Null languages aren't learned from. Each row is predicted from its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

PROFILE, TEXT_LIST, LENGTHS, CHUNK = 300, 300, (1, 2, 3), 1 << 20
UNKNOWN = "und"
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case) by code point; lower-casings that give several characters keep the first."""
    if not _TABLES:
        chars = [chr(i) for i in range(0x110000)]
        _TABLES.append(np.array([c.isalpha() for c in chars]))
        _TABLES.append(np.array([ord(c.lower()[0]) for c in chars], np.uint32))
    return _TABLES[0], _TABLES[1]


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds): letters of all texts, each text opened and closed by a space, other characters as one space."""
    letter, lower = _tables()
    texts = column.cast(pa.large_string()).fill_null("").to_pylist()
    cp = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)  # one past the closing space
    good = letter[cp]
    low = np.where(good, lower[cp], np.uint32(32))
    keep = good.copy()
    keep[1:] |= good[:-1]  # the space after a letter stays
    keep[ends - 1] = True  # and the closing one
    at = np.concatenate(([0], np.cumsum(keep)))
    return low[keep], at[np.concatenate(([0], ends))]


def grams(text: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of one text: code points in 21-bit fields, those of length 2 or 3 not starting and ending in a space only."""
    t = np.empty(len(text) + 1, np.uint64)
    t[0], t[1:] = 32, text
    one = text[text != 32].astype(np.uint64)
    two = (t[:-1] << np.uint64(21)) | t[1:]
    three = (t[:-2] << np.uint64(42)) | (t[1:-1] << np.uint64(21)) | t[2:]
    return np.concatenate((one, two[(t[:-1] != 32) | (t[1:] != 32)], three[t[1:-1] != 32]))


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters that end with no letter, so that n-grams of all parts are those of the text."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def counted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its n-grams and their counts."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    long = np.flatnonzero(pc.fill_null(pc.greater(pc.utf8_length(column), CHUNK), False).to_numpy(zero_copy_only=False))
    if len(long):  # each by itself, part by part
        at = 0
        for i in [*long.tolist(), len(column)]:
            if i > at:
                yield from counted(column.slice(at, i - at))
            if i < len(column):
                g, c = none
                for part in _parts(column[i].as_py()):
                    more, n = next(counted(pa.array([part]))) if len(part) <= CHUNK else next(_counted(pa.array([part])))
                    g, where = np.unique(np.concatenate((g, more)), return_inverse=True)
                    c = np.bincount(where, np.concatenate((c, n)), len(g)).astype(np.int64)
                yield g, c
            at = i + 1
        return
    yield from _counted(column)


def _counted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    text, bounds = letters(column)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            g = np.sort(grams(text[a:b]))
            at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            yield g[at], np.diff(np.append(at, len(g)))
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def learn(labelled: DataFrame, text: str, lang: str, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the profiles, from counts over all labelled texts. Each task sends its own sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            names = [k for k, v in sums.items() for _ in range(len(v[0]))]
            g = np.concatenate([v[0] for v in sums.values()]) if sums else np.zeros(0, np.uint64)
            c = np.concatenate([v[1] for v in sums.values()]) if sums else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(g.view(np.int64)), pa.array(c, pa.int64())], names=["lang", "gram", "n"])

        for b in K.sliced(batches, 0):
            held: dict[str, list] = {}
            for name, got in zip(b.column(1).to_pylist(), counted(b.column(0)), strict=True):
                held.setdefault(name, []).append(got)
            for name, parts in held.items():
                parts.append(sums.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
                g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                u, at = np.unique(g, return_inverse=True)
                sums[name] = (u, np.bincount(at, c, len(u)).astype(np.int64))
            if sum(len(v[0]) for v in sums.values()) > 500_000:
                yield out()
                sums = {}
        yield out()

    K.small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(run, "lang string, gram long, n long")
    total = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).select("lang", "gram", "rank")


def load_profiles(profiles: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages in order, known n-grams, ranks [language, n-gram] or the profile's length): size x languages rows, so lang must name languages, not rows."""
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    known = np.array(sorted({r["gram"] for r in rows}), np.int64)
    ranks = np.full((len(langs), len(known) + 1), -1, np.int32)
    for r in rows:
        ranks[langs.index(r["lang"]), np.searchsorted(known, r["gram"])] = r["rank"]
    return langs, known, ranks


def distances(found: np.ndarray, counts: np.ndarray, known: np.ndarray, ranks: np.ndarray, size: int = TEXT_LIST) -> tuple[np.ndarray, int]:
    """(out-of-place distance to each profile, the largest possible) of one text."""
    top = np.lexsort((found, -counts))[:size]
    g = found[top].view(np.int64)
    at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
    at = np.where(known[at] == g, at, len(known))
    r = ranks[:, at]
    own = np.arange(1, len(top) + 1, dtype=np.int32)
    off = np.where(r < 0, PROFILE, np.minimum(np.abs(r - own), PROFILE))
    return off.sum(axis=1), PROFILE * len(top)


def predict(docs: DataFrame, text: str, profiles: DataFrame, keep: list) -> DataFrame:
    """keep columns, lang_pred, score 0..1: the winner's closeness, and how clearly it won, in equal parts."""
    K.small_batches(docs.sparkSession)
    langs, known, ranks = load_profiles(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 0):
            names, scores = [], []
            for g, c in counted(b.column(0)):
                if not len(g) or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                d, most = distances(g, c, known, ranks)
                best = int(d.argmin())
                second = np.partition(d, 1)[1] if len(d) > 1 else most
                names.append(langs[best])
                scores.append(float(0.5 * (1 - d[best] / most) + 0.5 * (1 - d[best] / second if second else 0.0)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"])

    chosen = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in chosen.dtypes[1:]), "lang_pred string, score double"])
    return chosen.mapInArrow(run, schema)


def held_out(doc: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc.cast("string")) % 4 == 2, F.lit(False))
