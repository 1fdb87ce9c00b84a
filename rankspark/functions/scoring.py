"""Numeric expressions: BM25, cosine, rank metrics, costs, exact McNemar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the experiment.
K1, B = 1.5, 0.75
SHORTLIST_CAP = 200
BUDGETS = (0.01, 0.02, 0.05, 0.10, 0.20, 0.50, 1.00)


def bm25_odds(n_docs: Column, df: Column) -> Column:
    """What the inverse document frequency is the logarithm of."""
    d = F.greatest(F.lit(0.0), F.least(df.cast("double"), n_docs.cast("double")))
    return F.when(n_docs > 0, 1 + (n_docs - d + 0.5) / (d + 0.5)).otherwise(1.0)


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(bm25_odds(n_docs, df))


def bm25_term(tf: Column, dl: Column, avgdl: Column, idf: Column, k1: float = K1, b: float = B) -> Column:
    norm = F.when(avgdl > 0, b * dl / avgdl).otherwise(0.0)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + norm))  # in the order of the SQL, so that the doubles are the same


def as_double(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable_vector(v: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    inf = float("inf")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(inf)))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def budget_k(fraction: Column, n: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(fraction * n).cast("long"))


def reciprocal_rank(r: Column) -> Column:
    return F.lit(1.0) / r


def normalized_rank(r: Column, n: Column) -> Column:
    return r.cast("double") / n


def apfd(r: Column, n: Column) -> Column:
    return F.lit(1.0) - r.cast("double") / n + F.lit(1.0) / (2 * n)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def scores_agree(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts b and c, summed in log space; 1 without discordance.

    ln C(n, i) runs along the sum as ln C(n, i+1) = ln C(n, i) + ln((n-i)/(i+1)), so a row costs O(n).
    """
    n, k = (b + c).cast("double"), F.greatest(b, c)
    start = F.struct(F.lit(0.0).alias("lc"), F.lit(0.0).alias("p"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] + F.when(i >= k, F.exp(s["lc"] - n * F.log(F.lit(2.0)))).otherwise(0.0)
        more = F.when(i < n, F.log(F.greatest(n - i, F.lit(1.0)) / (i + 1))).otherwise(0.0)
        return F.struct((s["lc"] + more).alias("lc"), p.alias("p"))

    p = F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), start, step)["p"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * p))


def inference_usd(tokens: Column, usd_per_million: Column) -> Column:
    return tokens * usd_per_million / 1e6


def effective_usd(inference: Column, fee: Column) -> Column:
    return inference * (1 + fee)


def workload_usd(bugs: Column, candidates: Column, tokens_per_call: Column, usd_per_million: Column, fee: Column) -> Column:
    return effective_usd(inference_usd(F.ceil(bugs * candidates * tokens_per_call).cast("double"), usd_per_million), fee)


def percentage_points(delta: Column) -> Column:
    return delta * 100.0


def axis_ticks(lo: float, hi: float, n: int = 6) -> Column:
    """n even axis ticks."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(lo) + i * ((hi - lo) / (n - 1)))


def response_score(response: Column, question: str) -> Column:
    """The score of a response: `answers.<question>.noul`, or its text as JSON with the sole key `probability`; null otherwise."""
    text = F.get_json_object(response, "$.text")
    sole = F.json_object_keys(text) == F.array(F.lit("probability"))
    return F.coalesce(F.get_json_object(response, f"$.answers.{question}.noul").try_cast("double"), F.when(sole, F.get_json_object(text, "$.probability").try_cast("double")))
