"""Evaluation queries over two methods: BM25 and a seeded hash order, on items with a positive document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import audit, cohort, manifest, metrics, order, quantiles, randomized, stats
from ..sources.tables import table
from . import retrieval as R

QUERIES: dict = {}
SQL: dict[str, str] = {}
RANDOM_SEED, MISSING_EVERY = 7, 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


FIRST2 = f"""{R.FIRST}, hr AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY md5('{RANDOM_SEED}:' || b.item_id || ':' || d.doc_id), d.doc_id) AS rank FROM benchmark b CROSS JOIN documents d),
hf AS (SELECT item_id, min(rank) AS first_rank FROM hr JOIN pos USING (item_id, doc_id) GROUP BY 1),
m0 AS (SELECT 'BM25' AS method, item_id, first_rank FROM first_ranks UNION ALL SELECT 'Random', item_id, first_rank FROM hf),
m AS (SELECT method, item_id, item_id % 5 AS project, CAST(first_rank AS BIGINT) AS first_rank, n, 1.0 / first_rank AS rr, CAST(first_rank AS DOUBLE) / n AS nftr, 1 - CAST(first_rank AS DOUBLE) / n + 1.0 / (2 * n) AS apfd FROM m0 CROSS JOIN st)"""
K = "greatest(1, CAST(ceil(budget * n) AS BIGINT))"
GRID = "g AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0])::DOUBLE AS budget)"
AGG = "count(*) AS n_items, round(avg(rr), 6) AS mrr, round(avg(nftr), 6) AS mean_nftr, round(quantile_cont(nftr, 0.5), 6) AS median_nftr, round(avg(apfd), 6) AS mean_apfd"


def first_ranks(spark, d, judged: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(method, item, project, first_rank, n) of both methods; judged: R.judged(), if it is there."""
    docs, pos, first = R.judged(spark, d) if judged is None else judged
    lexical = first.select(F.lit("BM25").alias("method"), "item", "first_rank")
    hashed = randomized.hash_first_ranks(docs, pos, RANDOM_SEED).select(F.lit("Random").alias("method"), "item", "first_rank")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return lexical.unionByName(hashed).crossJoin(F.broadcast(n)).withColumn("project", F.col("item") % 5)


def item_metrics(spark, d) -> DataFrame:
    return metrics.item_metrics(first_ranks(spark, d))


@query(f"WITH {GRID} SELECT budget, n, {K} AS k FROM g CROSS JOIN (SELECT unnest([1, 7, 15, 50, 100, 434])::BIGINT AS n)")
def budget_k_grid(spark, d):
    ns = spark.createDataFrame([(1,), (7,), (15,), (50,), (100,), (434,)], "n long")
    return metrics.budget_grid(ns).select("budget", "n", S.budget_k(F.col("budget"), F.col("n")).alias("k"))


@query(f"WITH {FIRST2}, {GRID} SELECT method, budget, round(avg(CAST(first_rank <= {K} AS DOUBLE)), 6) AS fdr, count(*) AS n_items FROM m CROSS JOIN g GROUP BY 1, 2")
def fdr_by_budget(spark, d):
    return metrics.detection_rate(first_ranks(spark, d), ["method"])


@query(f"WITH {FIRST2} SELECT method, item_id, first_rank, round(rr, 9) AS rr, round(nftr, 9) AS nftr, round(apfd, 9) AS apfd FROM m")
def mrr_apfd_nftr(spark, d):
    return item_metrics(spark, d).select("method", F.col("item").alias("item_id"), "first_rank", *[F.round(c, 9).alias(c) for c in ("rr", "nftr", "apfd")])


@query(f"WITH {FIRST2} SELECT method, {AGG} FROM m GROUP BY 1")
def method_summary(spark, d):
    return metrics.summary(item_metrics(spark, d), ["method"])


@query(f"WITH {FIRST2} SELECT method, project, {AGG} FROM m GROUP BY GROUPING SETS ((method), (method, project))")
def project_grouping_sets(spark, d):
    return cohort.grouping_slices(item_metrics(spark, d), ("method", "project"), metrics.summary_columns())


@query(f"WITH {FIRST2} SELECT method, round(quantile_cont(nftr, 0.5), 6) AS median_nftr, round(quantile_cont(nftr, 0.95), 6) AS p95_nftr FROM m GROUP BY 1")
def median_nftr(spark, d):
    p = quantiles.percentiles(R.cut(item_metrics(spark, d).select("method", "nftr")), ["method"], "nftr", [0.5, 0.95])
    at = lambda share: F.round(F.max(F.when(F.col("share") == share, F.col("value"))), 6)
    return p.groupBy("method").agg(at(0.5).alias("median_nftr"), at(0.95).alias("p95_nftr"))


@query(f"WITH {FIRST2} SELECT method, row_number() OVER (PARTITION BY method ORDER BY nftr) AS i, round(nftr, 6) AS value, round(row_number() OVER (PARTITION BY method ORDER BY nftr) / count(*) OVER (PARTITION BY method), 6) AS p FROM m")
def empirical_cdf(spark, d):
    return metrics.empirical_cdf(item_metrics(spark, d), ["method"], "nftr")


@query(f"WITH {FIRST2} SELECT method, round(y / 10.0, 6)::DOUBLE AS y, round(avg(CAST(nftr <= y / 10.0 + 1e-15 AS DOUBLE)), 6) AS p FROM m CROSS JOIN range(11) t(y) GROUP BY 1, 2")
def grid_cdf(spark, d):
    return metrics.grid_cdf(item_metrics(spark, d), ["method"], "nftr")


def pairs(spark, d) -> DataFrame:
    m = item_metrics(spark, d).withColumn("detected", (F.col("first_rank") <= S.budget_k(F.lit(0.10), F.col("n"))).cast("double"))
    return stats.paired(R.cut(m), "BM25", "Random", ["item"], ["detected", "first_rank", "rr", "apfd", "nftr"])


PAIRS = f"""{FIRST2}, p AS (SELECT a.item_id, CAST(a.first_rank <= greatest(1, ceil(0.1 * a.n)) AS DOUBLE) AS da, CAST(b.first_rank <= greatest(1, ceil(0.1 * a.n)) AS DOUBLE) AS db,
a.first_rank AS ra, b.first_rank AS rb, a.rr AS rra, b.rr AS rrb, a.apfd AS aa, b.apfd AS ab, a.nftr AS na, b.nftr AS nb FROM m a JOIN m b USING (item_id) WHERE a.method = 'BM25' AND b.method = 'Random')"""
T22 = f"{PAIRS}, t AS (SELECT count(*) FILTER (da > 0 AND db > 0) AS both, count(*) FILTER (da > 0 AND db = 0) AS a_only, count(*) FILTER (da = 0 AND db > 0) AS b_only, count(*) FILTER (da = 0 AND db = 0) AS neither FROM p)"


@query(f"WITH {T22} SELECT *, a_only + b_only AS discordant FROM t")
def paired_2x2(spark, d):
    return stats.table_2x2(pairs(spark, d))


@query(f"""WITH {T22}, z AS (SELECT a_only + b_only AS n, greatest(a_only, b_only) AS k FROM t)
SELECT a_only, b_only, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, 1000000) r(i) WHERE i >= k AND i <= n)) END, 9) AS p_value FROM t CROSS JOIN z""")
def mcnemar_exact(spark, d):
    return stats.mcnemar(stats.table_2x2(pairs(spark, d))).select("a_only", "b_only", "p_value")


@query(f"WITH {PAIRS} SELECT round(avg(da - db), 6) AS fdr_delta, round(avg(rra - rrb), 6) AS mrr_delta, round(avg(aa - ab), 6) AS apfd_delta, round(quantile_cont(na, 0.5) - quantile_cont(nb, 0.5), 6) AS median_nftr_delta FROM p")
def point_deltas(spark, d):
    mean = lambda v: F.round(F.avg(F.col(f"{v}_a") - F.col(f"{v}_b")), 6)
    return pairs(spark, d).agg(mean("detected").alias("fdr_delta"), mean("rr").alias("mrr_delta"), mean("apfd").alias("apfd_delta"), F.round(F.median("nftr_a") - F.median("nftr_b"), 6).alias("median_nftr_delta"))


LISTED = f"{FIRST2}, li AS (SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) AS rank FROM documents d), lf AS (SELECT item_id, min(rank) AS first_rank FROM pos JOIN li USING (doc_id) GROUP BY 1), m3 AS (SELECT method, item_id, first_rank, n, rr FROM m UNION ALL SELECT 'Listing', item_id, first_rank, n, 1.0 / first_rank FROM lf CROSS JOIN st)"


@query(f"""WITH {LISTED}, c AS (SELECT * FROM (VALUES ('BM25', 'Random'), ('BM25', 'Listing'), ('Random', 'Listing')) t(a, b)),
j AS (SELECT c.a, c.b, CAST(x.first_rank <= greatest(1, CAST(ceil(0.1::DOUBLE * x.n) AS BIGINT)) AS INTEGER) AS da, CAST(y.first_rank <= greatest(1, CAST(ceil(0.1::DOUBLE * y.n) AS BIGINT)) AS INTEGER) AS db, x.rr - y.rr AS d FROM c JOIN m3 x ON x.method = c.a JOIN m3 y ON y.method = c.b AND y.item_id = x.item_id),
t AS (SELECT a, b, count(*) AS n_items, count(*) FILTER (da = 1 AND db = 0) AS a_only, count(*) FILTER (da = 0 AND db = 1) AS b_only, round(avg(da - db), 6) AS fdr_delta, round(avg(d), 6) AS mrr_delta FROM j GROUP BY 1, 2), z AS (SELECT *, a_only + b_only AS k0, greatest(a_only, b_only) AS k FROM t)
SELECT a, b, n_items, a_only, b_only, fdr_delta, mrr_delta, round(CASE WHEN k0 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(k0 + 1) - lgamma(i + 1) - lgamma(k0 - i + 1) - k0 * ln(2))) FROM range(0, 100000) r(i) WHERE i >= k AND i <= k0)) END, 9) AS p_value FROM z""")
def contrasts(spark, d):
    """One primary and two further contrasts, with the documents' listing as a third method."""
    judged = docs, pos, _ = R.judged(spark, d)
    first = pos.groupBy("item").agg(F.min("doc").alias("doc"))
    listed = order.numbered(docs, "doc").join(first, "doc").select("item", (F.col("position") + 1).alias("first_rank"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    ranks = first_ranks(spark, d, judged).select("method", "item", "first_rank", "n")
    m = metrics.item_metrics(ranks.unionByName(listed.crossJoin(F.broadcast(n)).select(F.lit("Listing").alias("method"), "item", "first_rank", "n")))
    m = R.cut(m.withColumn("detected", (F.col("first_rank") <= S.budget_k(F.lit(0.10), F.col("n"))).cast("double")))
    out = None
    for a, b in (("BM25", "Random"), ("BM25", "Listing"), ("Random", "Listing")):
        p = stats.paired(m, a, b, ["item"], ["detected", "rr"])
        t = stats.mcnemar(stats.table_2x2(p)).select("a_only", "b_only", "p_value")
        one = p.agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg(F.col("detected_a") - F.col("detected_b")), 6).alias("fdr_delta"), F.round(F.avg(F.col("rr_a") - F.col("rr_b")), 6).alias("mrr_delta")).crossJoin(t)
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n_items", "a_only", "b_only", "fdr_delta", "mrr_delta", "p_value")
        out = one if out is None else out.unionByName(one)
    return out


SAMPLES, SEED = 10_000, 20260922


def numbered(spark, d) -> DataFrame:
    """Pairs with pos 0..n-1 in the order of their items."""
    p = order.numbered(pairs(spark, d), "item", name="pos")
    return p.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("n"))))  # one row


@query(f"""WITH {PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM p),
dr AS (SELECT s AS sample, CAST('0x' || substr(md5('{SEED}:' || s || ':' || pos), 1, 8) AS BIGINT) % n AS pos FROM o CROSS JOIN range({SAMPLES}) r(s)),
b AS (SELECT sample, avg(da - db) AS delta FROM dr JOIN o USING (pos) GROUP BY 1)
SELECT round(quantile_cont(delta, 0.025), 6) AS lo, round(quantile_cont(delta, 0.975), 6) AS hi, count(*) AS n_samples FROM b""")
def bootstrap_ci_hash(spark, d):
    p = numbered(spark, d)
    delta = stats.hash_draws(SAMPLES, p, SEED).groupBy("sample").agg(F.avg(F.col("detected_a") - F.col("detected_b")).alias("delta"))
    return stats.percentile_interval(delta, "delta")


@query()
def bootstrap_ci_mt(spark, d):
    p = numbered(spark, d)
    n = p.count()
    if not n:
        return spark.createDataFrame([], "lo double, hi double, n_samples long")
    return stats.percentile_interval(stats.bootstrap_delta(stats.mersenne_draws(spark, n, SAMPLES, SEED), p, "detected_a", "detected_b"), "delta")


@query(f"""WITH {PAIRS}, x AS (SELECT item_id, rb - ra AS delta, CAST(sign(rb - ra) AS INTEGER) AS sign FROM p), g AS (SELECT * FROM x ORDER BY delta DESC, item_id LIMIT 10),
l AS (SELECT * FROM x WHERE item_id NOT IN (SELECT item_id FROM g) ORDER BY delta, item_id LIMIT 10)
SELECT *, 'gain' AS arm, row_number() OVER (ORDER BY delta DESC, item_id) AS arm_rank FROM g UNION ALL SELECT *, 'loss', row_number() OVER (ORDER BY delta, item_id) FROM l""")
def rank_delta_top10(spark, d):
    rows = cohort.rank_deltas(pairs(spark, d), "first_rank_b", "first_rank_a", "item", 10)
    rows = manifest.arm_ranks(rows, "arm", F.when(F.col("arm") == "gain", -F.col("delta")).otherwise(F.col("delta")), F.col("item"))
    return rows.select(F.col("item").alias("item_id"), "delta", "sign", "arm", "arm_rank")


@query(f"WITH {PAIRS} SELECT CAST(sign(rb - ra) AS INTEGER) AS sign, count(*) AS n_items FROM p GROUP BY 1")
def failure_arms(spark, d):
    return pairs(spark, d).groupBy(F.signum(F.col("first_rank_b") - F.col("first_rank_a")).cast("int").alias("sign")).agg(F.count(F.lit(1)).alias("n_items"))


@query(f"""WITH {FIRST2} SELECT CASE WHEN first_rank <= greatest(1, ceil(0.01 * n)) THEN 'detected' WHEN first_rank <= {R.SHORT} THEN 'reranker_miss' ELSE 'candidate_generation_miss' END AS class,
count(*) AS n_items, min(item_id) AS first_item, max(item_id) AS last_item FROM m WHERE method = 'BM25' GROUP BY 1""")
def miss_classification(spark, d):
    m = R.first_ranks(spark, d).crossJoin(F.broadcast(R.inventory(spark, d).agg(F.count(F.lit(1)).alias("n"))))
    return cohort.classify_misses(m, F.col("first_rank") <= S.budget_k(F.lit(0.01), F.col("n")), F.col("first_rank") <= R.SHORT, "item")


@query(f"""WITH {FIRST2}, x AS (SELECT item_id, n, CASE WHEN item_id % {MISSING_EVERY} = 0 THEN NULL ELSE first_rank END AS r FROM m WHERE method = 'BM25')
SELECT item_id, r IS NULL AS imputed, coalesce(r, n) AS first_rank, round(coalesce(r, n) / CAST(n AS DOUBLE), 9) AS nftr, round(1.0 / coalesce(r, n), 9) AS rr, CASE WHEN r IS NULL THEN 0.0 ELSE CAST(r <= greatest(1, ceil(0.1 * n)) AS DOUBLE) END AS detected_10 FROM x""")
def impute_worst_case(spark, d):
    m = first_ranks(spark, d).filter("method = 'BM25'").withColumn("first_rank", F.when(F.col("item") % MISSING_EVERY != 0, F.col("first_rank")))
    return metrics.impute_worst(m).select(F.col("item").alias("item_id"), "imputed", "first_rank", F.round("nftr", 9).alias("nftr"), F.round("rr", 9).alias("rr"), "detected_10")


CASES = ((0.80, 0.70, 0.90, 0.25), (0.90, 0.88, 0.91, 0.50), (0.90, 0.88, 0.91, 0.25), (0.90, 0.91, 0.70, 0.25), (0.50, 0.48, 0.90, 0.10))


@query(f"""WITH c AS (SELECT fdr::DOUBLE AS fdr, baseline::DOUBLE AS baseline, peer::DOUBLE AS peer, cost_ratio::DOUBLE AS cost_ratio FROM (VALUES {', '.join(map(str, CASES))}) t(fdr, baseline, peer, cost_ratio)),
x AS (SELECT *, fdr >= baseline + 0.05::DOUBLE AS one, abs(fdr - peer) <= 0.02::DOUBLE AND cost_ratio <= 0.3::DOUBLE AS two FROM c)
SELECT fdr, baseline, peer, cost_ratio, one OR two AS success, CASE WHEN one THEN 'alternative_1' WHEN two THEN 'alternative_2' ELSE 'none' END AS via FROM x""")
def practical_success(spark, d):
    cases = spark.createDataFrame(list(CASES), "fdr double, baseline double, peer double, cost_ratio double")
    return cohort.practical_success(cases, *[F.col(c) for c in cases.columns])


@query(f"WITH {FIRST2}, s AS (SELECT method, round(avg(rr), 6) AS mrr FROM m GROUP BY 1) SELECT method, mrr, abs(mrr - max(mrr) OVER ()) < 1e-12 AS best FROM s")
def headline_best_ties(spark, d):
    return cohort.mark_best(metrics.summary(item_metrics(spark, d), ["method"]).select("method", "mrr"), "mrr")


@query(f"WITH {FIRST2} SELECT method, count(*) AS n_items, round(avg(rr), 6) AS mrr FROM m WHERE item_id % {MISSING_EVERY} <> 0 GROUP BY 1")
def cohort_exclusion(spark, d):
    gaps = R.items(spark, d).filter(F.col("item") % MISSING_EVERY == 0)
    return cohort.exclude(item_metrics(spark, d), gaps, ["item"]).groupBy("method").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(f"WITH {FIRST2}, s AS (SELECT item_id, method, first_rank FROM m) SELECT item_id, max(first_rank) FILTER (method = 'BM25') AS bm25_rank, max(first_rank) FILTER (method = 'Random') AS random_rank FROM s GROUP BY 1")
def method_pivot(spark, d):
    p = first_ranks(spark, d).groupBy("item").pivot("method", ["BM25", "Random"]).agg(F.max("first_rank"))
    return p.select(F.col("item").alias("item_id"), F.col("BM25").alias("bm25_rank"), F.col("Random").alias("random_rank"))


@query("""WITH x AS (SELECT c_mktsegment AS segment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_mktsegment || ':' || c_custkey), CAST(c_custkey AS VARCHAR)) AS position FROM customer)
SELECT segment, c_custkey, position, CASE WHEN position <= 5 THEN 'development' ELSE 'evaluation' END AS split FROM x WHERE position <= 30""")
def stratified_sample_hash(spark, d):
    s = randomized.stratified_hash_sample(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 42, 30, 5)
    return s.select(F.col("c_mktsegment").alias("segment"), "c_custkey", "position", "split")


@query()
def sample_mt(spark, d):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return randomized.mersenne_sample(table(spark, d, "customer"), "c_mktsegment", "c_custkey", segments, 42, 30, 5)


HASHRANK = f"WITH x AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('{RANDOM_SEED}:' || label || ':' || vec_id), vec_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


@query(f"{HASHRANK} SELECT label, vec_id, rank FROM x")
def random_rank_hash(spark, d):
    return randomized.hash_ranks(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], "vec_id", RANDOM_SEED)


REPS = 1_000
REPL = f"""WITH x AS (SELECT s AS replicate, label, vec_id, row_number() OVER (PARTITION BY s, label ORDER BY md5(s || ':' || label || ':' || vec_id), vec_id) AS rank, count(*) OVER (PARTITION BY s, label) AS n FROM embeddings CROSS JOIN range({REPS}) r(s)),
f AS (SELECT replicate, label, min(rank) AS r, any_value(n) AS n FROM x WHERE vec_id % 9 = 0 GROUP BY 1, 2)"""


def replicates(spark, d) -> DataFrame:
    """(replicate, label, first_rank, n): hash permutations of each label's vectors; ids divisible by 9 are positive.

    Only the first positive counts, so an aggregate finds it: rank = 1 + ids whose hash is smaller. A label's best keys of all
    replicates are one row, joined before the vectors are repeated, so that repeated rows are only counted where they are made.
    """
    e = table(spark, d, "embeddings").select("label", "vec_id")
    key = lambda replicate: F.struct(F.md5(F.concat_ws(":", replicate, "label", "vec_id")).alias("h"), "vec_id")
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(REPS - 1).cast("long"))
    best = e.filter("vec_id % 9 = 0").withColumn("replicate", F.explode(numbers)).groupBy("replicate", "label").agg(F.min(key(F.col("replicate"))).alias("best"))
    best = R.cut(best.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("replicate", "best"))).alias("bests")))  # REPS a label
    each = e.join(order.small(best, 100), "label").select("label", "vec_id", F.explode("bests").alias("b")).select("label", "vec_id", "b.replicate", "b.best")
    return each.groupBy("replicate", "label").agg((F.count_if(key(F.col("replicate")) < F.col("best")) + 1).alias("first_rank"), F.count(F.lit(1)).alias("n"))


@query(f"{REPL} SELECT label, round(avg(1.0 / r), 6) AS rr, round(avg(r / CAST(n AS DOUBLE)), 6) AS nftr, round(avg(CAST(r <= greatest(1, ceil(0.1 * n)) AS DOUBLE)), 6) AS fdr10 FROM f GROUP BY 1")
def random_mean_metrics_hash(spark, d):
    r = metrics.item_metrics(replicates(spark, d))
    hit = (F.col("first_rank") <= S.budget_k(F.lit(0.10), F.col("n"))).cast("double")
    return r.groupBy("label").agg(F.round(F.avg("rr"), 6).alias("rr"), F.round(F.avg("nftr"), 6).alias("nftr"), F.round(F.avg(hit), 6).alias("fdr10"))


@query(f"{REPL}, g AS (SELECT replicate, quantile_cont(r / CAST(n AS DOUBLE), 0.5) AS m FROM f GROUP BY 1) SELECT round(avg(m), 6) AS median_nftr, count(*) AS n_replicates FROM g")
def random_replicate_median(spark, d):
    r = metrics.item_metrics(replicates(spark, d)).groupBy("replicate").agg(F.median("nftr").alias("m"))
    return r.agg(F.round(F.avg("m"), 6).alias("median_nftr"), F.count(F.lit(1)).alias("n_replicates"))


@query("""WITH x AS (SELECT label, count(*) AS n, count(*) FILTER (vec_id % 9 = 0) AS t FROM embeddings GROUP BY 1), y AS (SELECT *, greatest(1, CAST(ceil(0.1 * n) AS BIGINT)) AS k FROM x)
SELECT label, n, t, k, round(1 - CASE WHEN n - t < k THEN 0.0 ELSE exp(lgamma(n - t + 1) - lgamma(n - t - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) END, 6) AS fdr FROM y""")
def random_closed_form_fdr(spark, d):
    """1 - C(n-t, k) / C(n, k) as a product of k factors."""
    x = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % 9 == 0).alias("t")).withColumn("k", S.budget_k(F.lit(0.10), F.col("n")))
    miss = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), F.lit(0.0), lambda s, i: s + F.log(F.greatest(F.col("n") - F.col("t") - i, F.lit(1)) / (F.col("n") - i)))
    return x.withColumn("fdr", F.round(F.when(F.col("n") - F.col("t") < F.col("k"), 1.0).otherwise(1 - F.exp(miss)), 6))


def turn_groups(spark, d):
    """(conv_id, turn, seed_index, good): a conversation's turns as an inventory, its place among the conversations as the index of its seed."""
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3 == 1).alias("good"))
    every = c.select(F.lit("all").alias("split"), F.col("conv_id").alias("id"), F.col("conv_id").alias("position")).distinct()
    return c.join(manifest.split_rows(every, "all").select(F.col("id").alias("conv_id"), F.col("index").alias("seed_index")), "conv_id")


@query()
def random_permutations_mt(spark, d):
    return randomized.permutations(turn_groups(spark, d), "conv_id", "turn", 1337, REPS)


@query()
def random_metrics_mt(spark, d):
    return randomized.permutation_metrics(turn_groups(spark, d), "conv_id", "turn", "good", 1_001_337, REPS)


@query(f"WITH {R.FULL} SELECT item_id, doc_id, 'quality_label' AS leaked FROM ranked WHERE rank <= 3 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def label_leak_audit(spark, d):
    """Shortlisted documents that carry a private label."""
    top = R.prefix(spark, d, 3)
    bad = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("doc"))
    return R.named(top.join(bad, "doc", "left_semi").select("item", "doc", F.lit("quality_label").alias("leaked")))


@query("SELECT 'tax' AS rule, l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_tax <= 0.07) UNION ALL SELECT 'quantity', l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 49)")
def finite_range_audit(spark, d):
    rules = {"tax": S.finite(F.col("l_tax")) & (F.col("l_tax") <= 0.07), "quantity": F.col("l_quantity").between(1, 49)}
    return audit.violations(table(spark, d, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


@query("SELECT coalesce(o.o_custkey, c.c_custkey) AS custkey, CASE WHEN o.o_custkey IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM (SELECT DISTINCT o_custkey FROM orders) o FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) c ON o.o_custkey = c.c_custkey WHERE o.o_custkey IS NULL OR c.c_custkey IS NULL")
def key_reconcile_full_outer(spark, d):
    expected = table(spark, d, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("custkey"))
    return audit.reconcile_keys(expected, table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query("SELECT 'odd_status' AS rule, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n FROM orders UNION ALL SELECT 'price', count(*) FILTER (NOT o_totalprice >= 1000) FROM orders UNION ALL SELECT 'key', count(*) FILTER (o_orderkey IS NULL) FROM orders")
def audit_counts(spark, d):
    rules = {"odd_status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") >= 1000, "key": F.col("o_orderkey").isNotNull()}
    return audit.violation_counts(table(spark, d, "orders"), rules)
