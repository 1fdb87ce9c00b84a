"""Postings by bytes equal the token arrays, and sums don't depend on their order."""

import random

from pyspark.sql import functions as F

from rankspark.operators import lexical

PIECES = ["parseHTTPResponse", "a1B2c", "ABc", "AB", "Ab", "x", "XMLHttp", "  ", "\n", "é", "ñAñ", "日本Go", "İK", "_", "-", "9", "99A", "zz", "Zz", "HTTP", "s", "S", "😀"]


def test_postings_are_those_of_the_token_arrays(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 300)
    rng = random.Random(4)
    texts = ["", None, "A", "aB", "HTTPResponse", "X", "Yz", "AB", "c"] + ["".join(rng.choices(PIECES, k=rng.randrange(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = lexical.token_frame(docs, "doc_id", "text")
    terms = tokens.select(F.lit(1).alias("item"), F.explode("tokens").alias("term")).filter("hash(term) % 3 <> 0")
    rows = lambda df: sorted((r.doc, r.dl, r.term, r.tf) for r in df.collect())
    assert rows(lexical.postings_of(docs, "doc_id", "text", terms)) == rows(lexical.postings(tokens, terms))
    assert rows(lexical.postings_of(docs.filter("false"), "doc_id", "text", terms)) == []


def test_copies_have_one_score_in_any_order(spark):
    rng = random.Random(5)
    parts = [rng.random() * 10 ** rng.uniform(-6, 1.5) for _ in range(60)]
    rows = [(g, p) for g in range(200) for p in rng.sample(parts, len(parts))]
    got = spark.createDataFrame(rows, "g int, p double").repartition(9).groupBy("g").agg(lexical.exact_sum(F.col("p")).alias("s")).select("s").distinct().collect()
    import math
    assert len(got) == 1 and abs(got[0].s - math.fsum(parts)) <= 1e-13


def test_the_tasks_of_the_scores_grow_with_the_pairs(spark, monkeypatch):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("ab cd "), F.col("id") % 7).alias("text"))
    terms = spark.range(20).select(F.col("id").alias("item"), F.explode(F.array(F.lit("ab"), F.lit("cd"))).alias("term"))
    post = lexical.postings_of(docs, "doc_id", "text", terms).cache()
    want = sorted(tuple(r) for r in lexical.scores(post, terms).collect())
    monkeypatch.setattr(lexical, "MOST_PAIRS", 500)
    few = lexical.scores(post, terms)
    assert few.rdd.getNumPartitions() >= 600 * 40 / 500 and sorted(tuple(r) for r in few.collect()) == want and len(want) == 12_000
    full = lexical.scores(post, terms, tail=spark.createDataFrame([(0,), (77,)], "item long"))
    assert full.filter("item = 77").count() == 600 and full.filter("item = 77 and score = 0").count() == 600 and full.count() == 12_600


def test_sums_of_pieces_are_those_of_spark(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(300)], "doc_id long, text string").repartition(5)
    terms = spark.createDataFrame([(f"i{i}", t) for i in range(30) for t in rng.sample(words, 9)] + [(None, "w1")], "item string, term string")
    post = lexical.postings_of(docs, "doc_id", "text", terms).cache()
    part = post.filter("term <> ''").join(lexical.weights(post), "term").select("doc", "term", lexical.S.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), lexical.S.bm25_idf(F.col("n_docs"), F.col("df"))).alias("part"))
    want = part.join(terms, "term").groupBy("item", "doc").agg(lexical.rounded(lexical.exact_sum(F.col("part")), 9).alias("score"))
    rows = lambda df: sorted(((r["item"] or "", r.doc, r.score) for r in df.collect()))
    want = rows(want)
    monkeypatch.setattr(lexical, "LIST", 7)
    for pairs, few in ((1 << 19, 100_000), (60, 100_000), (60, 10)):  # few: also where terms are too many to be broadcast
        monkeypatch.setattr(lexical, "PIECE_PAIRS", pairs)
        monkeypatch.setattr(lexical, "FEW_GROUPS", few)
        assert rows(lexical.scores(post, terms)) == want and len(want) > 5_000
        assert sorted(tuple(r) for r in lexical.postings_of(docs, "doc_id", "text", terms).collect()) == sorted(tuple(r) for r in post.collect())


def test_scores_are_neither_expanded_nor_aggregated_by_rows(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("ab cd "), F.col("id") % 7).alias("text"))
    terms = spark.range(20).select(F.col("id").alias("item"), F.explode(F.array(F.lit("ab"), F.lit("cd"))).alias("term"))
    post = lexical.postings_of(docs, "doc_id", "text", terms)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(post)  # other terms don't leave the tokenizer
    assert "HashAggregate" not in plan(lexical.scores(post.cache(), terms)).split("InMemoryTableScan")[0]


def test_tasks_give_only_what_can_be_among_the_best(spark, monkeypatch):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("ab"), (F.col("id") % 37 + 1).cast("int")), F.lit("cd")).alias("text"))
    terms = spark.createDataFrame([(i, t) for i in range(9) for t in ("ab", "cd")[i % 2 :]], "item long, term string")
    post = lexical.postings_of(docs, "doc_id", "text", terms).cache()
    from rankspark.operators import blockmax
    rows = lambda df: sorted(tuple(r) for r in blockmax.best(df, 5).collect())
    want = rows(lexical.scores(post, terms))
    few = lexical.scores(post, terms, best=5)
    assert rows(few) == want and len(want) == 45 and few.count() < 8_000 < lexical.scores(post, terms).count()
    monkeypatch.setattr(lexical, "PIECE_PAIRS", 50)  # cuts of cuts, and rows given as they come
    assert rows(lexical.scores(post, terms, best=5)) == want


def test_weights_have_the_logarithms_of_sql(spark):
    import duckdb
    n = 512_820
    known = spark.range(1, n, 371).select(F.col("id").alias("df"), F.lit(n).cast("long").alias("n_docs"))
    got = [r.idf for r in lexical.with_idf(known).orderBy("df").collect()]
    want = [x for (x,) in duckdb.sql(f"SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM (SELECT {n}::BIGINT AS n, range AS df FROM range(1, {n}, 371)) ORDER BY df").fetchall()]
    assert got == want
