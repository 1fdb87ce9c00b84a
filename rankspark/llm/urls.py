"""URL filters: host and path rules, else the ratio of two character language models.

Two smoothed variable-order Markov models (orders 0 to 5, each interpolated with the shorter one by Witten-Bell weights)
learn the characters of accepted and of rejected URLs. A URL's score is the difference of its log-likelihoods per character;
the threshold is calibrated on a held-out fifth of the labelled URLs, and balances the errors of both kinds.

Labels come from the rules: URLs that a rule allows are accepted, those that one blocks are rejected. All of them count.
Counts are exact: a gram (a character and the ORDERS - 1 before it) is packed into one number, the table of gram counts grows
with the labelled URLs, and the shorter orders' counts are sums of it. Grams of all URLs are joined to it, never the driver.
Null urls, and urls without `://`, have an empty host and path and no rule; null urls are allowed with a null score. If a
class has no URL to learn from, all urls without a rule are allowed with a null score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

ORDERS, BITS, FOLDS = 6, 9, 5  # a byte + 1 takes 9 bits, 0 stands before the start
# a list to begin with; op6's contract has other words for net/de, which its query passes
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    found = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), found).otherwise("")


def path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(h: Column, p: Column, rules: tuple = RULES) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | F.endswith(h, F.lit("." + name))) & F.startswith(p, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, grams) of the texts' bytes: the lowest BITS bits hold the byte, the next the one before it, and so on."""
    data, offsets = K.buffers(column)
    n = len(data)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    code, gram = data.astype(np.int64) + 1, np.zeros(n, np.int64)
    for k in range(ORDERS):
        before = np.zeros(n, np.int64)
        before[k:] = code[: max(0, n - k)]
        before[place < k] = 0  # beyond the start
        gram |= before << (BITS * k)
    return offsets, gram


def gram_counts(rows: DataFrame, url: str, accepted: str) -> DataFrame:
    """(gram, yes, no): every gram of the URLs, with its count in accepted and in rejected ones; a URL with null accepted counts in neither."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 0, 1 << 14):
            offsets, gram = _grams(b.column(0))
            side = np.array([-1 if x is None else int(x) for x in b.column(1).to_pylist()], np.int64)
            u, at = np.unique(gram, return_inverse=True)
            counts = [np.bincount(at, np.repeat(side == v, np.diff(offsets)), len(u)).astype(np.int64) for v in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, *counts)], names=["gram", "yes", "no"])

    out = rows.select(F.col(url).alias("url"), F.col(accepted).alias("accepted")).mapInArrow(run, "gram long, yes long, no long")
    return out.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log-probability of the gram's character in accepted URLs minus that in rejected ones."""
    seen = counts.filter("yes > 0 or no > 0")
    out = counts.select("gram", F.lit(1 / 256).alias("p_yes"), F.lit(1 / 256).alias("p_no"))
    for k in range(ORDERS):
        cell = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("cell")
        cells = seen.groupBy(cell).agg(F.sum("yes").alias("c_yes"), F.sum("no").alias("c_no"))
        of = [f(x).alias(n + x[1:]) for x in ("c_yes", "c_no") for n, f in (("n", F.sum), ("f", lambda c: F.count_if(F.col(c) > 0)))]
        contexts = cells.groupBy(F.shiftright("cell", BITS).alias("ctx")).agg(*of)
        if k < 2:  # at most 257 contexts of 256 characters
            cells, contexts = F.broadcast(cells), F.broadcast(contexts)
        out = out.withColumn("cell", cell).withColumn("ctx", F.shiftright("cell", BITS)).join(cells, "cell", "left").join(contexts, "ctx", "left")
        p = []
        for v in ("yes", "no"):
            c, n, f = F.coalesce(f"c_{v}", F.lit(0)), F.col(f"n_{v}"), F.col(f"f_{v}")
            p.append(F.when(n > 0, (c + f * F.col(f"p_{v}")) / (n + f)).otherwise(F.col(f"p_{v}")).alias(f"p_{v}"))
        out = out.select("gram", *p)
    return out.select("gram", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def scores(pages: DataFrame, ratio: DataFrame, url: str) -> DataFrame:
    """(url, score): log-likelihood of accepted minus rejected per character, of each distinct URL that isn't null or empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 1, 1 << 14):
            offsets, gram = _grams(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(offsets)))), pa.array(gram)], names=["u", "gram"])

    each = K.cut(pages.select(F.col(url).alias("url")).filter("length(url) > 0").distinct().withColumn("u", F.monotonically_increasing_id()))
    sums = each.select("u", "url").mapInArrow(run, "u long, gram long").join(ratio, "gram").groupBy("u").agg(F.avg("ratio").alias("score"))
    return each.join(sums, "u").select("url", F.round("score", 9).alias("score"))  # rounded: sums in any order agree


def calibrate(held: DataFrame, score: str, accepted: str) -> float:
    """The threshold at which as large a share of accepted URLs falls below as of rejected ones lies above: from exact percentiles."""
    steps = [i / 200 for i in range(201)]
    row = held.agg(*[F.percentile(F.when(F.col(accepted) == F.lit(v), F.col(score)), steps).alias(str(v)) for v in (True, False)]).first()
    yes, no = row["True"], row["False"]
    if yes is None or no is None:
        return 0.0
    yes, no = np.array(yes), np.array(no)
    best = min(sorted({*yes, *no, 0.0}), key=lambda t: ((yes < t).mean() + (no >= t).mean(), abs(t)))
    below, above = no[no < best], yes[yes >= best]
    return float((below.max() + above.min()) / 2) if len(below) and len(above) else float(best)


def judged(pages: DataFrame, page: str = "page_id", url: str = "url", rules: tuple = RULES) -> DataFrame:
    """(page, host, path, rule, verdict, score)."""
    K.small_batches(pages.sparkSession)
    u = F.col(url).cast("string")
    frame = pages.select(F.col(page).alias("page"), u.alias("url"), host(u).alias("host"), path(u).alias("path"))
    frame = frame.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    frame = frame.select("page", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    accepted = F.when(F.col("ruled").isNotNull(), F.col("ruled") == "allow")
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    counts = K.cut(gram_counts(frame.select("url", F.when(~held, accepted).alias("accepted")), "url", "accepted"))
    row = counts.agg(F.sum("yes"), F.sum("no")).first()
    if not row[0] or not row[1]:
        return frame.select("page", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    out = frame.join(K.cut(scores(frame, K.cut(ratios(counts)), "url")), "url", "left")
    threshold = calibrate(out.filter(held).select("score", accepted.alias("accepted")).filter("accepted is not null"), "score", "accepted")
    own = F.when(F.col("score").isNull() | (F.col("score") >= threshold), "allow").otherwise("block")
    return out.select("page", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
