"""Searches that skip blocks and clusters, against full rankings."""

import random

import pytest
from pyspark.sql import functions as F

from rankspark.operators import blockmax, lexical, ranking
from rankspark.plans import retrieval


def corpus(spark, n, seed):
    rng = random.Random(seed)
    langs = [[f"{p}{i}" for i in range(40)] for p in ("ab", "cd", "ef")]
    docs = []
    for i in range(n):
        words = rng.choice(langs)
        docs.append((i, " ".join(rng.choices(words, range(40, 0, -1), k=rng.randrange(1, 40)))))
    docs += [(n, None), (n + 1, ""), (n + 2, docs[3][1]), (n + 3, docs[3][1])]
    items = [(i, " ".join(rng.choices(rng.choice(langs), k=rng.randrange(1, 6)))) for i in range(12)] + [(20, None), (21, "zz nothing")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("block", "k", "seeds"), [(16, 20, 4), (3, 5, 8), (64, 1, 1), (5, 1_000, 2)])
def test_block_max_equals_the_full_ranking(spark, tmp_path, block, k, seeds):
    docs, items = corpus(spark, 700, block)
    terms = lexical.query_terms(items, "item_id", "text")
    posted = lexical.postings(lexical.token_frame(docs, "doc_id", "text"), terms).cache()
    path = f"file://{tmp_path}/index"
    blockmax.build(posted, path, block)
    index = blockmax.load(spark, path)
    assert index[0].select(F.max(F.size("docs"))).first()[0] <= block
    got = {(r["item"], r.doc, r.score, r["rank"]) for r in blockmax.search(index, terms, k, seeds).collect()}
    want = {(r["item"], r.doc, r.score, r["rank"]) for r in ranking.shortlist(ranking.rank_by_score(lexical.scores(posted, terms), ["item"]), ["item"], k).collect()}
    assert got == want and got
    kept, every = blockmax.wanted_blocks(index, terms, k, seeds)
    assert kept.count() <= every.count() and (k > 5 or block > 16 or kept.count() < every.count() / 2)


def test_block_bounds_hold(spark, tmp_path):
    docs, items = corpus(spark, 200, 9)
    terms = lexical.query_terms(items, "item_id", "text")
    posted = lexical.postings(lexical.token_frame(docs, "doc_id", "text"), terms).cache()
    blockmax.build(posted, f"file://{tmp_path}/index", 7)
    index = blockmax.load(spark, f"file://{tmp_path}/index")
    every = blockmax.bounds(index, terms)
    of = index[0].select("block", F.explode("docs.doc").alias("doc")).distinct()
    over = lexical.scores(posted, terms).join(of, "doc").join(every, ["item", "block"], "left").filter(F.col("bound").isNull() | (F.col("score") > F.col("bound") + 1e-9))
    assert over.count() == 0


def test_prefix_is_that_of_the_full_ranking(spark, tmp_path):
    docs, items = corpus(spark, 90, 4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.unionByName(spark.createDataFrame([(30, "ab1 cd1 ef1 ab2 cd2 ef2 " + " ".join(f"{p}{i}" for p in ("ab", "cd", "ef") for i in range(40)))], items.schema)).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda df: sorted((r["item"], r["rank"], r.doc, r.score) for r in df.collect())
    for k in (1, 7, 60, 200):
        assert rows(retrieval.prefix(spark, str(tmp_path), k)) == rows(retrieval.full_ranking(spark, str(tmp_path)).filter(F.col("rank") <= k))


def test_nothing_to_search(spark, tmp_path):
    docs, items = corpus(spark, 20, 1)
    for d, i in ((docs.filter("false"), items), (docs, items.filter("false"))):
        terms = lexical.query_terms(i, "item_id", "text")
        blockmax.build(lexical.postings(lexical.token_frame(d, "doc_id", "text"), terms), f"file://{tmp_path}/none")
        assert blockmax.search(blockmax.load(spark, f"file://{tmp_path}/none"), terms, 3).collect() == []


@pytest.mark.parametrize(("n", "d", "spread", "k"), [(900, 8, 0.05, 5), (300, 24, 1.0, 20), (40, 3, 0.3, 60)])
def test_cosine_by_clusters_equals_all_pairs(spark, n, d, spread, k):
    import numpy as np

    from rankspark.operators import vectors

    rng = np.random.default_rng(d)
    middle = rng.normal(size=(12, d))
    x = middle[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [float(c) for c in x[5]]), (n + 4, [1e200] * d), (n + 5, [1.0] * (d + 1)), (n + 6, [2.0] * (d + 1)), (n + 7, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    q = df.filter("id % 7 = 0 or id > " + str(n)).select(F.col("id").alias("item"), F.col("v").alias("qv"))
    b = df.select(F.col("id").alias("doc"), "v")
    got = {(r["item"], r["rank"]): (r.doc, r.score) for r in vectors.topk(q, b, k, rows=20).collect()}
    ok = [(i, np.array(v)) for i, v in rows if v and all(np.isfinite(v)) and any(v)]
    ok = [(i, (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max())) for i, v in ok]
    want = {}
    for i, v in ok:
        if i % 7 == 0 or i > n:
            for rank, (s, j) in enumerate(sorted((-round(float(v @ w), 9), j) for j, w in ok if j != i and len(w) == len(v))[:k], 1):
                want[i, rank] = (j, -s)
    assert set(got) == set(want) and all(abs(got[x][1] - want[x][1]) < 2e-9 for x in want)
    assert sum(got[x][0] == want[x][0] for x in want) >= 0.99 * len(want)  # equal but for sums in another order
    seen, of = vectors.looked_at(q, b, k, d, rows=20)
    assert seen <= of and (spread > 0.1 or seen < of / 2)
