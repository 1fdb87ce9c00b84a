"""Retrieval queries: benchmark items against documents (BM25) and vectors against vectors (cosine)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import scoring as S
from ..functions.text import tokenize
from ..operators import blockmax, cohort, judging, lexical, ranking, vectors
from ..sources.scratch import cut, shared_folder
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOPK, SHORT = 20, S.SHORTLIST_CAP


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def tok_sql(x: str) -> str:
    split = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_filter(list_transform(string_split_regex({split}, '[^A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1)"


TOK = f"tok AS (SELECT doc_id, {tok_sql('text')} AS toks FROM documents), dl AS (SELECT doc_id, len(toks) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"
BM25 = f"""{TOK}, q AS (SELECT DISTINCT item_id, unnest({tok_sql('text')}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT q.item_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN tf USING (term) JOIN dfq USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY 1, 2)"""
FULL = f"""{BM25}, ranked AS (SELECT b.item_id, d.doc_id, coalesce(sc.score, 0.0) AS score,
  row_number() OVER (PARTITION BY b.item_id ORDER BY coalesce(sc.score, 0.0) DESC, d.doc_id) AS rank
  FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc_id = d.doc_id)"""
POS = "pos AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
FIRST = f"{FULL}, {POS}, first_ranks AS (SELECT item_id, min(rank) AS first_rank FROM ranked JOIN pos USING (item_id, doc_id) GROUP BY 1)"
VEC = """vp AS (SELECT q.vec_id AS item_id, b.vec_id AS doc_id, q.label = b.label AS good,
  round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q JOIN embeddings b ON q.vec_id % 25 = 0 AND q.vec_id <> b.vec_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM vp)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return lexical.token_frame(spread(table(spark, d, "documents").select("doc_id", "text"), key="doc_id"), "doc_id", "text")


def terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.query_terms(table(spark, d, "benchmark"), "item_id", "text")


def posted(spark: SparkSession, d: str) -> DataFrame:
    """Postings of all query terms, written once: the only reading and tokenizing of the documents."""
    return cut(lexical.postings_of(spread(table(spark, d, "documents").select("doc_id", "text"), key="doc_id"), "doc_id", "text", terms(spark, d)))


def scored(spark: SparkSession, d: str, best: int | None = None) -> DataFrame:
    return lexical.scores(posted(spark, d), terms(spark, d), best=best)


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("item"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"))


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inventory, positives, first ranks) from one reading of the documents; positives are documents that contain the item's passage."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), key="doc_id")
    return judging.judged(docs, "doc_id", "text", table(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text"))


def first_ranks(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d)[2]


def full_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_by_score(lexical.scores(posted(spark, d), terms(spark, d), tail=items(spark, d)), ["item"])


def prefix(spark: SparkSession, d: str, k: int = SHORT) -> DataFrame:
    """The first k rows of every item's full ranking, without the ranking.

    Where fewer than k documents match, all that match are there, and the smallest ids that don't follow: they are among the k
    smallest of all ids, as at most the matching ones can be in their way.
    """
    top = cut(blockmax.best(scored(spark, d, k), k))
    short = items(spark, d).distinct().join(top.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item", "left").filter(F.coalesce("n", F.lit(0)) < k).select("item")
    first = inventory(spark, d).orderBy("doc").limit(k)
    tail = cut(short).crossJoin(first).join(top, ["item", "doc"], "left_anti")
    return blockmax.best(top.select("item", "doc", "score").unionByName(tail.select("item", "doc", F.lit(0.0).alias("score"))), k)


def named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"item": "item_id", "doc": "doc_id"})


@query(f"WITH {TOK} SELECT doc_id, CAST(dl AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM tok JOIN dl USING (doc_id)")
def tok_documents(spark, d):
    return tokens(spark, d).select(F.col("doc").alias("doc_id"), F.col("dl").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(f"WITH {TOK}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok) SELECT term, count(*) AS df FROM t GROUP BY 1")
def tok_vocab_df(spark, d):
    return tokens(spark, d).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {TOK} SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl, CAST(sum(dl) AS BIGINT) AS total_tokens FROM dl")
def bm25_corpus_stats(spark, d):
    return lexical.corpus_stats(tokens(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM dfq CROSS JOIN st")
def bm25_idf(spark, d):
    post = posted(spark, d)
    return lexical.document_frequency(post).crossJoin(F.broadcast(lexical.corpus_stats(lexical.documents_of(post)))).select("term", "df", F.round(S.bm25_idf(F.col("n_docs"), F.col("df")), 9).alias("idf"))


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= {TOPK}")
def bm25_scores_top20(spark, d):
    return named(ranking.shortlist(ranking.rank_by_score(scored(spark, d, TOPK), ["item"]), ["item"], TOPK)).select("item_id", "doc_id", "score", "rank")


@query(SQL["bm25_scores_top20"])
def bm25_topk_blockmax(spark, d):
    """The same from a block-max index, written first, whose search leaves out the blocks that can't hold one of the best."""
    path = f"{shared_folder(spark)}/blockmax-{uuid.uuid4().hex}"
    blockmax.build(posted(spark, d), path)
    return named(blockmax.search(blockmax.load(spark, path), terms(spark, d), TOPK)).select("item_id", "doc_id", "score", "rank")


@query(f"WITH {FULL} SELECT item_id, doc_id, score, rank FROM ranked")
def bm25_full_rank(spark, d):
    return named(full_ranking(spark, d)).select("item_id", "doc_id", "score", "rank")


@query(f"WITH {FIRST} SELECT item_id, CAST(first_rank AS BIGINT) AS first_rank FROM first_ranks")
def bm25_first_positive_rank(spark, d):
    return named(first_ranks(spark, d))


@query(f"WITH {BM25}, m AS (SELECT item_id, count(*) AS matched FROM sc WHERE score > 0 GROUP BY 1) SELECT b.item_id, coalesce(matched, 0) AS matched, n - coalesce(matched, 0) AS zero_tail FROM benchmark b LEFT JOIN m USING (item_id) CROSS JOIN st")
def bm25_zero_tail(spark, d):
    got = scored(spark, d).filter("score > 0").groupBy("item").agg(F.count(F.lit(1)).alias("matched"))
    n = inventory(spark, d).agg(F.count(F.lit(1)).alias("n"))
    out = items(spark, d).join(got, "item", "left").crossJoin(F.broadcast(n))
    return named(out.select("item", F.coalesce("matched", F.lit(0)).alias("matched"), (F.col("n") - F.coalesce("matched", F.lit(0))).alias("zero_tail")))


@query(f"WITH {FULL} SELECT item_id, CAST(least({SHORT}, max(rank)) AS BIGINT) AS k, max(rank) AS n FROM ranked GROUP BY 1")
def shortlist_k(spark, d):
    n = inventory(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return named(items(spark, d).crossJoin(F.broadcast(n)).select("item", F.least(F.lit(SHORT).cast("long"), "n").alias("k"), "n"))


@query(f"WITH {FIRST} SELECT round(avg(CAST(first_rank <= {SHORT} AS DOUBLE)), 6) AS recall, count(*) AS n_items FROM first_ranks")
def shortlist_recall(spark, d):
    return cohort.candidate_recall(first_ranks(spark, d).withColumn("hit", F.col("first_rank") <= SHORT), "hit")


@query(f"WITH {FULL} SELECT item_id, sha256(string_agg(doc_id || chr(10), '' ORDER BY rank)) AS sha256, count(*) AS k FROM ranked WHERE rank <= {SHORT} GROUP BY 1")
def shortlist_hash(spark, d):
    return named(ranking.shortlist_digest(prefix(spark, d), ["item"], "doc"))


def external_scores(base: DataFrame) -> DataFrame:
    """A hash-made score in [0, 1) for each shortlisted pair, as a model would give."""
    digest = H.order_hash(11, F.col("item"), F.col("doc"))
    return base.select("item", "doc", (F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") / 65536.0).alias("ext_score"))


RERANK_K = 10
EXT = "(CAST('0x' || substr(md5('11:' || item_id || ':' || doc_id), 1, 4) AS BIGINT) / 65536.0)"


@query(f"""WITH {FULL}, s AS (SELECT item_id, doc_id, rank AS base_rank, CASE WHEN rank <= {RERANK_K} THEN {EXT} END AS ext_score FROM ranked WHERE rank <= {SHORT})
SELECT item_id, doc_id, base_rank, round(ext_score, 9) AS ext_score, row_number() OVER (PARTITION BY item_id ORDER BY base_rank > {RERANK_K}, ext_score DESC NULLS LAST, base_rank) AS rank FROM s""")
def rerank_prefix_tail(spark, d):
    base = prefix(spark, d).withColumnRenamed("rank", "base_rank").drop("score")
    out = ranking.rerank(base, external_scores(base.filter(F.col("base_rank") <= RERANK_K)), ["item"], "doc", RERANK_K)
    return named(out).select("item_id", "doc_id", "base_rank", F.round("ext_score", 9).alias("ext_score"), "rank")


@query(f"""WITH {FULL} SELECT CASE WHEN rank <= {RERANK_K} THEN 'missing' ELSE 'extra' END AS rule, item_id, doc_id FROM ranked
WHERE (rank <= {RERANK_K} AND doc_id % 7 = 0) OR (rank > {RERANK_K} AND rank <= {RERANK_K + 2} AND doc_id % 7 <> 0)""")
def rerank_missing_scores_audit(spark, d):
    """A damaged score table: keys divisible by 7 are lost, two tail rows are scored."""
    base = prefix(spark, d).withColumnRenamed("rank", "base_rank").drop("score")
    damaged = external_scores(base.filter((F.col("base_rank") <= RERANK_K + 2) & (F.col("doc") % 7 != 0)))
    return named(ranking.rerank_violations(base, damaged, ["item"], "doc", RERANK_K))


@query(f"WITH {FULL} SELECT 'missing' AS rule, item_id, doc_id FROM ranked WHERE rank <= 5 AND rank = 3 UNION ALL SELECT 'ranks', item_id, NULL FROM ranked WHERE rank = 3")
def rank_permutation_audit(spark, d):
    """Whole rankings of which the third row is lost, against every item's whole inventory."""
    whole = items(spark, d).distinct().crossJoin(inventory(spark, d))
    return named(ranking.permutation_violations(cut(full_ranking(spark, d).filter("rank <> 3").select("item", "doc", "rank")), whole, ["item"], "doc"))


@query(f"WITH {FULL} SELECT item_id, doc_id, rank, 'missing' AS rule FROM ranked WHERE rank = 2 UNION ALL SELECT item_id, doc_id, 2, 'extra' FROM ranked WHERE rank = {SHORT + 1}")
def prefix_audit(spark, d):
    """Stored shortlists in which rank 2 holds the first document after the cut."""
    full = cut(prefix(spark, d, SHORT + 1))
    stored = full.filter("rank <> 2").withColumn("rank", F.when(F.col("rank") == SHORT + 1, F.lit(2).cast("long")).otherwise(F.col("rank")))
    return named(ranking.prefix_violations(stored, full, ["item"], "doc", SHORT))


def vector_queries(spark, d):
    """(queries, base): every 25th vector against all."""
    e = spread(table(spark, d, "embeddings"), key="vec_id")
    q = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("item"), F.col("embedding").alias("qv"))
    return q, e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))


@query(f"WITH {VEC} SELECT item_id, doc_id, score, rank FROM vr WHERE rank <= {TOPK}")
def cosine_topk(spark, d):
    return named(vectors.topk(*vector_queries(spark, d), TOPK)).select("item_id", "doc_id", "score", "rank")


def vector_first_ranks(spark, d):
    """(item, first_rank, n): documents ahead of the best positive are counted, so no ranking is sorted."""
    e = spread(table(spark, d, "embeddings"), key="vec_id")
    q = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("item"), F.col("embedding").alias("qv"), F.col("label").alias("own"))
    return vectors.first_ranks(q, e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label"))


@query(f"WITH {VEC} SELECT item_id, min(rank) FILTER (good) AS first_rank, count(*) AS n FROM vr GROUP BY 1 HAVING bool_or(good)")
def cosine_first_positive_rank(spark, d):
    return named(vector_first_ranks(spark, d))
