"""Line dedup by log templates in a fixed-depth tree.

A line's tokens are its words; a word with a digit is a variable field. The tree's levels are the token count, then the
LEAD leading words, variable ones as one field. Two lines of a leaf have one template if they agree in SIMILAR of their
tokens; the rest are its fields. A line goes if an earlier document (a smaller id) holds a line of its template, so a
template's first document keeps it and no content vanishes. In leaves of fewer than LEAST tokens all lines have one template;
short sentences meet by chance, so there a template goes only from MANY documents on. Blank lines stay.

The rule is the same at every size. One scan writes a row for each distinct line of each document. Masked lines that come
again need no comparison. For the others, lines that agree in SIMILAR of their tokens must agree on one whole segment if their
other tokens are cut into one segment more than may differ, so lines meet by segment. First every line is compared with the
earliest line of each segment it shares; only lines that this leaves undecided are compared with all others of their
segments, in pairs of blocks. Words are compared by 16 bits: one in 65,536 differing words counts as equal. Texts move once,
to meet the list of lines that they lose.

Null texts stay null. Rows with a null id keep their lines and don't count. Extra columns pass through. Rows that repeat an
id are one document: a line of theirs doesn't recur by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LEAD, SIMILAR, LEAST, MANY, BLOCK, BUCKET = 3, 0.7, 5, 10, 2_048, 20_000
FIELD = np.uint64(0x5EED_F1E1D)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def masked_lines(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(document of each line, its hash, leaf, first word, tokens, masked word hashes) of all lines; blank lines have 0 tokens."""
    data, offsets = K.buffers(column)
    h, starts, _ = K.words(data, offsets, False)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    h = np.where(digits[ends] > digits[starts], FIELD, h) if len(h) else h
    breaks = np.flatnonzero(data == 10) + 1
    # a line starts at each text's start and after each line feed
    line = np.sort(np.concatenate((offsets[:-1], breaks)), kind="stable")
    owner = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(breaks, offsets, "right")))
    first = np.searchsorted(starts, line)
    n = np.diff(np.append(first, len(starts)))
    # an empty text's line must not take the next text's words: those start at the same byte
    upto = np.searchsorted(starts, np.append(line[1:], len(data)))
    n = np.minimum(n, upto - first)
    up, down = K._powers(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(h) * up[: len(h)], dtype=np.uint64)))
        span = lambda a, b: K.mix((total[b] - total[a]) * down[np.minimum(a, len(h))] + (b - a).astype(np.uint64))
        last = first + n
        code = span(first, last)
        leaf = K.mix(span(first, np.minimum(first + LEAD, last)) + n.astype(np.uint64) * np.uint64(K.STEP))
    return owner, code, leaf, first, n, h


def document_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, h, leaf, tokens, words): the distinct non-blank lines of every document."""
    K.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 1):
            owner, code, leaf, first, n, h = masked_lines(b.column(1))
            order = np.lexsort((code, owner))
            order = order[n[order] > 0]
            o, c = owner[order], code[order]
            order = order[np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])))] if len(order) else order
            small = (h >> np.uint64(48)).astype(np.uint16)
            words = [small[a : a + m].tobytes() if m >= LEAST else b"" for a, m in zip(first[order].tolist(), n[order].tolist(), strict=True)]
            ids = b.column(0).take(pa.array(owner[order]))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x[order].view(np.int64)) for x in (code, leaf)], pa.array(n[order].astype(np.int32)), pa.array(words, pa.binary())], names=["doc", "h", "leaf", "tokens", "words"])

    rows = docs.filter(F.col(doc).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, h long, leaf long, tokens int, words binary")


def tokens_needed(n: np.ndarray | int, similar: float = SIMILAR):
    """In how many of n tokens two lines of a template agree."""
    return np.ceil(similar * np.asarray(n) - 1e-9).astype(np.int64)


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds) of a column of 16-bit words."""
    data, offsets = K.raw(column)
    return np.frombuffer(data.tobytes(), np.uint16), offsets // 2


def segments(leaf: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of every line's segments: one more than tokens that may differ, over the tokens behind the leading ones."""
    n = np.diff(bounds)
    free = n - LEAD
    pieces = np.minimum(n - tokens_needed(n) + 1, free)
    line = np.repeat(np.arange(len(n)), pieces)
    i = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (bounds[:-1] + LEAD)[line]
    a, b = start + free[line] * i // pieces[line], start + free[line] * (i + 1) // pieces[line]
    up, down = K._powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(words.astype(np.uint64) + np.uint64(1)) * up[: len(words)], dtype=np.uint64)))
        return line, K.mix(K.mix((total[b] - total[a]) * down[a]) + leaf.view(np.uint64)[line] + i.astype(np.uint64) * np.uint64(K.STEP)).view(np.int64)


def same_template(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether pairs of equally long lines agree in enough tokens."""
    equal = np.concatenate(([0], np.cumsum(a == b)))
    return equal[bounds[1:]] - equal[bounds[:-1]] >= tokens_needed(np.diff(bounds))


def earlier_match(words: np.ndarray, first: np.ndarray, against: np.ndarray, against_first: np.ndarray) -> np.ndarray:
    """Whether each line has a line of its template among those of smaller documents; words, against: a line a row."""
    out, need = np.zeros(len(words), bool), int(tokens_needed(words.shape[1]))
    step = max(1, 4_000_000 // max(1, against.size))
    for s in range(0, len(words), step):
        w = words[s : s + step]
        equal = np.count_nonzero(w[:, None, :] == against[None, :, :], axis=2)
        out[s : s + step] = ((equal >= need) & (against_first[None, :] < first[s : s + step, None])).any(axis=1)
    return out


def _follows_leader(cells: DataFrame, sketch: DataFrame) -> DataFrame:
    """(h): lines that have the template of the earliest line of a segment they share, which an earlier document holds."""
    lead = cells.groupBy("cell").agg(F.min_by("h", "first").alias("lead"), F.min("first").alias("a"), F.max("first").alias("b")).filter("a < b").select("cell", "lead", "a")
    pairs = K.cut(K.join_hot(cells, lead, "cell", "h").filter("first > a").select("h", "lead").distinct())
    both = K.join_hot(pairs, sketch.select(F.col("h").alias("lead"), F.col("words").alias("lead_words")), "lead", "h")
    both = both.join(sketch.select("h", "words"), "h").select("h", "words", "lead_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 1, 1 << 16):
            (x, at), (y, other) = _lists(b.column(1)), _lists(b.column(2))
            fit = np.diff(at) == np.diff(other)
            if not fit.all():  # two leaves of one hash
                b = b.filter(pa.array(fit))
                (x, at), (y, other) = _lists(b.column(1)), _lists(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(same_template(x, y, at)))], names=["h"])

    return both.mapInArrow(run, "h long").distinct()


def _follows_any(cells: DataFrame, sketch: DataFrame, done: DataFrame) -> DataFrame:
    """(h): lines not done that have the template of any other line of a segment they share, which an earlier document holds."""
    marked = cells.join(done.select("h", F.lit(True).alias("done")), "h", "left").withColumn("open", F.col("done").isNull()).drop("done")
    marked = K.cut(marked)
    left = marked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("a"), F.count_if("open").alias("m"), F.max(F.when(F.col("open"), F.col("first"))).alias("b")).filter("n > 2 and a < b")
    parts = F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")
    # open lines stand together, in the first parts of their segment
    opened = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int").alias("opened")
    rows = K.cut(K.join_hot(marked, left.select("cell", parts, opened), "cell", "h").withColumn("part", F.pmod(F.xxhash64("h"), F.when(F.col("open"), F.col("opened")).otherwise(F.col("parts"))).cast("int")).drop("opened"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    asks = rows.filter("open").select("cell", F.col("part").alias("i"), other, "h", "first", F.lit(True).alias("ask")).withColumnRenamed("other", "j")
    # held lines go only to blocks that ask; both sides are written, so a hot segment's part of the join can be split
    asked = K.cut(rows.filter("open").select("cell", F.col("part").alias("i")).distinct())
    holds = rows.join(asked, "cell").select("cell", "i", F.col("part").alias("j"), "h", "first", F.lit(False).alias("ask"))
    total = rows.count()
    dealt = asks.unionByName(holds).withColumn("bucket", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(max(1, total // BUCKET)).cast("long"))).join(sketch.select("h", "words"), "h")

    def run(table: pa.Table) -> pa.Table:
        words, at = _lists(table.column("words"))
        cell, i, j, h, first, ask = (table.column(c).to_numpy() for c in ("cell", "i", "j", "h", "first", "ask"))
        size = np.diff(at)
        order = np.lexsort((size, j, i, cell))  # equal sizes, but for two leaves of one hash
        keys = [x[order] for x in (cell, i, j, size)]
        cuts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]), [True]))) if len(order) else [0]
        hits = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            some = order[s:e]
            mine = ask[some]
            if mine.any():
                m = words[at[some][:, None] + np.arange(size[some[0]])]
                hits.append(h[some[mine]][earlier_match(m[mine], first[some[mine]], m[~mine], first[some[~mine]])])
        return pa.table({"h": pa.array(np.concatenate(hits) if hits else np.zeros(0, np.int64), pa.int64())})

    return dealt.groupBy("bucket").applyInArrow(run, "h long").distinct()


def templates(lines: DataFrame) -> DataFrame:
    """(h, keep): masked lines that recur and the document that keeps them, or null where an earlier one holds their template."""
    short = lines.filter(F.col("tokens") < LEAST).select("h", "leaf", "doc").distinct()
    many = short.groupBy("leaf").agg(F.countDistinct("doc").alias("docs"), F.min("doc").alias("keep")).filter(F.col("docs") >= MANY)
    gone = short.select("h", "leaf").distinct().join(many, "leaf").select("h", "keep")
    kinds = K.cut(lines.filter(F.col("tokens") >= LEAST).groupBy("h", "leaf").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
    several = kinds.groupBy("leaf").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b and n > 1").select("leaf")
    compared = K.join_hot(kinds, several, "leaf", "h").select("h", F.col("first").alias("doc"))
    sketch = K.cut(lines.join(compared, ["h", "doc"]).select("h", "leaf", F.col("doc").alias("first"), "words").dropDuplicates(["h"]))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 3, 1 << 14):
            line, cell = segments(b.column(1).to_numpy(), *_lists(b.column(3)))
            take = pa.array(line)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0).take(take), b.column(2).take(take)], names=["cell", "h", "first"])

    cells = K.cut(sketch.mapInArrow(cut_up, "cell long, h long, first long"))
    done = K.cut(_follows_leader(cells, sketch))
    followers = K.cut(done.unionByName(_follows_any(cells, sketch, done)).select("h", F.lit(True).alias("follows")))
    long = kinds.join(followers, "h", "left").filter("first < last or follows").select("h", F.when(F.col("follows").isNull(), F.col("first")).alias("keep"))
    return gone.unionByName(long)


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with recurring lines dropped from text, plus _lines, _dropped (in place of columns so named): the lines of a row and those dropped."""
    docs = docs.drop("_lines", "_dropped")
    lines = K.cut(document_lines(docs, doc, text))
    gone = K.cut(templates(lines))
    hit = K.join_hot(lines.select("doc", "h"), gone, "h", "doc").filter("keep is null or doc <> keep")
    per_doc = hit.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("h").alias("_gone"))  # bounded by the document's own lines
    names = docs.columns
    inner = docs.toDF(*[f"in{i}" for i in range(len(names))])  # no name of docs can clash
    joined = inner.join(per_doc, F.col(f"in{names.index(doc)}").cast("long") == F.col("_doc"), "left").drop("_doc")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, at):
            column = b.column(at).cast(pa.large_string())
            texts = column.to_pylist()
            owner, code, _, _, n, _ = masked_lines(column)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            dropped = np.zeros(len(texts), np.int64)
            for i, g in enumerate(b.column(len(names)).to_pylist()):
                if g is not None and texts[i]:
                    s = slice(bounds[i], bounds[i + 1])
                    off = np.isin(code[s].view(np.int64), np.array(g, np.int64)) & (n[s] > 0)
                    dropped[i] = off.sum()
                    texts[i] = "\n".join(t for t, x in zip(texts[i].split("\n"), off, strict=True) if not x)
            count = np.where(np.array(column.is_null()), 0, np.diff(bounds))
            columns = [*b.columns[: len(names)]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count), pa.array(dropped)], names=[*names, "_lines", "_dropped"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {'string' if c == text else kinds[c]}" for c in names), "_lines long, _dropped long"])
    return joined.mapInArrow(run, schema)
