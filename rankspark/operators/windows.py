"""Line windows of long sources: sliding windows, top windows, islands, overlap-free concatenation, greedy compaction."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T

# Fixed values of the experiment.
SIZE, STRIDE, HEADER_LINES, MAX_LINES, MAX_WINDOWS = 80, 60, 40, 240, 3
OMITTED = "// [...SOURCE LINES OMITTED...]"


def tokens(text: str) -> list[str]:
    """functions.text.tokenize() for code that runs in Python."""
    spaced = re.sub(T.CAMEL_ACRONYM, r"\1 \2", re.sub(T.CAMEL_LOWER_UPPER, r"\1 \2", text))
    return [t.lower() for t in re.split(T.NON_ALNUM, spaced) if len(t) > 1]


def line_windows(n: Column, size: int = SIZE, stride: int = STRIDE) -> Column:
    """Array of (start, end): starts 0, stride, ...; ends once a window reaches the last line."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + size, n).cast("int").alias("end")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def top_windows(scored: DataFrame, by: list[str], k: int) -> DataFrame:
    """k best by score, earlier start first among equals; returned with their source order."""
    w = Window.partitionBy(*by)
    best = scored.withColumn("pick", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("start"))).cast("long")).filter(F.col("pick") <= k)
    return best.withColumn("position", F.row_number().over(w.orderBy("start")).cast("long"))


def islands(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Consecutive integers as half-open ranges (start, end)."""
    key = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return df.select(*by, at).distinct().withColumn("island", key).groupBy(*by, "island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("island")


def without_overlap(spans: DataFrame, by: list[str]) -> DataFrame:
    """Each span loses the lines that earlier spans have given; empty ones go."""
    w = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.greatest(F.col("start"), F.coalesce(F.max("end").over(w), F.col("start")))
    return spans.select(*by, cut.alias("start"), "end").filter("start < end")


def window_scores(tokens: list[list[str]], query: list[str]) -> list[float]:
    """BM25 of each window of one text, which is the whole corpus here."""
    n, terms = len(tokens), set(query)
    lengths = [len(t) for t in tokens]
    average = sum(lengths) / n if n else 0.0
    counts = [Counter(x for x in t if x in terms) for t in tokens]
    holders = Counter(x for c in counts for x in c)
    idf = {x: math.log1p((n - df + 0.5) / (df + 0.5)) for x, df in holders.items()}
    norm = [S.K1 * (1 - S.B + S.B * (length / average if average else 0.0)) for length in lengths]
    return [sum(idf[x] * tf * (S.K1 + 1) / (tf + k) for x, tf in sorted(c.items())) for c, k in zip(counts, norm, strict=True)]


def compact_source(text: str, query: list[str]) -> dict:
    """A text of at most MAX_LINES lines whole; of a longer one the header and up to MAX_WINDOWS windows, each next by score x share of lines not yet kept.

    Equal windows: the earlier. Windows without a new line don't count. A gap becomes the omission mark, and so does a cut-off end.
    """
    lines = text.split("\n")
    spans = [(a, min(a + SIZE, len(lines))) for a in range(0, max(len(lines) - SIZE, 0) + STRIDE, STRIDE) if a == 0 or a < len(lines) - SIZE + STRIDE]
    if len(lines) <= MAX_LINES:
        return {"mode": "full", "lines": lines, "ranges": [(0, len(lines))], "picked": [], "windows": 0}
    scores = window_scores([tokens("\n".join(lines[a:b])) for a, b in spans], query)
    kept = np.zeros(len(lines), bool)
    kept[:HEADER_LINES] = True
    left, picked = set(range(len(spans))), []
    while left and len(picked) < MAX_WINDOWS and kept.sum() < MAX_LINES:
        fresh = {i: int((~kept[slice(*spans[i])]).sum()) for i in left}
        best = min(left, key=lambda i: (-scores[i] * fresh[i] / (spans[i][1] - spans[i][0]), spans[i][0]))
        left.discard(best)
        if fresh[best]:
            new = spans[best][0] + np.flatnonzero(~kept[slice(*spans[best])])
            kept[new[: MAX_LINES - int(kept.sum())]] = True
            picked.append((*spans[best], scores[best]))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], kept, [False]))))
    ranges = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    out: list[str] = []
    for a, b in ranges:
        out += [OMITTED] * (a > 0) + lines[a:b]  # the header starts at 0
    if ranges[-1][1] < len(lines):
        out.append(OMITTED)
    return {"mode": "windows", "lines": out, "ranges": ranges, "picked": sorted(picked), "windows": len(spans)}


def compact_sources(df: DataFrame, key: str, text: str, terms: str) -> DataFrame:
    """(key, mode, n_lines, windows_total, windows_selected, scores, ranges, compact): see compact_source(); null texts are empty.

    Each choice depends on the ones before it, so this loop runs in Python, one text at a time.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, q in zip(pdf[key], pdf[text], pdf[terms], strict=True):
                source = (t or "").replace("\r\n", "\n").replace("\r", "\n")
                c = compact_source(source, [] if q is None else list(q))
                spans = lambda x: ",".join(f"{a}-{b}" for a, b, *_ in x)
                out.append((k, c["mode"], source.count("\n") + 1, c["windows"], spans(c["picked"]), [float(s) for *_, s in c["picked"]], spans(c["ranges"]), "\n".join(c["lines"])))
            yield pd.DataFrame(out, columns=[key, "mode", "n_lines", "windows_total", "windows_selected", "scores", "ranges", "compact"])

    return df.select(key, text, terms).mapInPandas(run, f"{key} {kind}, mode string, n_lines long, windows_total long, windows_selected string, scores array<double>, ranges string, compact string")


def unified_diff(df: DataFrame, key: str, fixed: str, buggy: str, context: int = 3) -> DataFrame:
    """(key, diff): fixed as minus side, buggy as plus side; null texts are empty, equal ones give an empty diff."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        for pdf in batches:
            diffs = ["".join(difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), f"a/{k}", f"b/{k}", n=context)) for k, a, b in zip(pdf[key], pdf[fixed], pdf[buggy], strict=True)]
            yield pd.DataFrame({key: pdf[key], "diff": diffs})

    return df.select(key, fixed, buggy).mapInPandas(run, f"{key} {kind}, diff string")


def full_diff(diffs: DataFrame, by: list[str], path: str, diff: str) -> DataFrame:
    """(by, diff): the files' diffs of each change in the order of their paths, ended by a line feed; a change has few files."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(diff).alias("d")))), lambda s: s["d"])
    whole = diffs.groupBy(*by).agg(F.array_join(parts, "").alias("diff"))
    return whole.withColumn("diff", F.when((F.col("diff") != "") & ~F.endswith("diff", F.lit("\n")), F.concat("diff", F.lit("\n"))).otherwise(F.col("diff")))
