"""First ranks from one reading of the documents equal those of the joins, and neither texts nor postings are shuffled."""

import random

import numpy as np
import pytest

from rankspark.operators import judging, lexical, randomized

WORDS = [f"w{i}" for i in range(60)]


def case(spark, seed):
    rng = random.Random(seed)
    zipf = [1 / (i + 1) for i in range(60)]
    passages = [" ".join(rng.choices(WORDS, zipf, k=rng.randrange(3, 12))) for _ in range(25)] + ["? !", "x y", "", None, "w1", "w1 Ab", "nowhere to be found here"]
    texts = []
    for i in range(500):
        t = " ".join(rng.choices(WORDS, zipf, k=rng.randrange(0, 40)))
        if i % 5 == 0:
            t += (" x y ? ! é " if i % 10 else " ") + (rng.choice(passages[:25])) + rng.choice(["", " w1", "b w2"])
        texts.append(None if i % 61 == 60 else t)
    docs = spark.createDataFrame([(i * 7919 % 5003, t) for i, t in enumerate(texts + texts[:40], 1)], "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame(list(enumerate(passages)), "item long, text string")


def test_one_reading_gives_what_the_joins_give(spark, monkeypatch):
    for seed, few in ((1, 1 << 21), (2, 300)):
        docs, items = case(spark, seed)
        monkeypatch.setattr(lexical, "PIECE", few)
        monkeypatch.setattr(lexical, "PIECE_PAIRS", few)
        rows = lambda frames: [sorted(tuple(r) for r in df.collect()) for df in frames]
        got = rows(judging.judged(docs, "doc_id", "text", items))
        monkeypatch.setattr(judging, "MOST_TEXT", 0)
        assert got == rows(judging.judged(docs, "doc_id", "text", items))
        monkeypatch.undo()
        assert len(got[0]) == 540 and 25 < len(got[2]) < 32 and {25, 26, 27} <= {i for i, _ in got[2]}  # items without a term too
        body = {r.doc_id: r.text for r in docs.collect()}
        assert got[1] == sorted((i.item, d) for i in items.collect() for d, t in body.items() if i.text is not None and t is not None and i.text in t)
    assert [len(x) for x in rows(judging.judged(docs.filter("false"), "doc_id", "text", items))] == [0, 0, 0] == [len(x) - 540 * (k == 0) for k, x in enumerate(rows(judging.judged(docs, "doc_id", "text", items.filter("false"))))]


def test_texts_and_postings_stay_in_their_tasks(spark):
    docs, items = case(spark, 3)
    q = judging.queries(items)
    rows = judging.packed(docs, "doc_id", "text", q).cache()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    w = judging.weights(rows, q)
    best = judging.positive_scores(rows, q, w).selectExpr("item", "score as best_score", "doc as best_doc").dropDuplicates(["item"]).toArrow()
    for df in (judging.packed(spark.read.schema("doc_id long, text string").parquet(written(docs)), "doc_id", "text", q), judging.counts_ahead(rows, q, w, best), judging.positive_scores(rows, q, w)):
        assert "Exchange" not in plan(df).split("InMemoryTableScan")[0] and "Join" not in plan(df)


def written(docs):
    import tempfile

    path = tempfile.mkdtemp() + "/docs"
    docs.write.parquet(path)
    return path


def test_only_essential_terms_lead_to_a_document():
    import pyarrow as pa

    lists = judging.lists(np.array([0, 0, 0, 1, 1, 2]), np.array([0, 1, 2, 1, 2, 0]), 3)
    q = judging.Queries(pa.array(["a", "b", "c"]), pa.array([7, 8, 9]), lists, [], np.zeros(0, int), lists)
    by_term, rest = judging.essential(q, judging.Weights(np.array([0.1, 1.0, 4.0]), 5.0), np.array([5.0, 0.0, np.nan]))
    assert [by_term.of(np.array([t]))[1].tolist() for t in range(3)] == [[], [1], [0, 1]]  # 2.5 * (0.1 + 1.0) < 5
    assert rest.tolist() == [pytest.approx(2.75), 0.0, 0.0]


def test_hash_ranks_are_counted_as_in_whole_orders(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(randomized, "MOST_PAIRS", 100)

    docs = spark.range(300).selectExpr("id * 3 as doc")
    positives = [(i, d * 3) for i in range(9) for d in range(i, 300, 40 + i)]
    ranks = randomized.hash_first_ranks(docs, spark.createDataFrame(positives, "item long, doc long"), 7)
    assert "RoundRobinPartitioning(27)" in ranks._jdf.queryExecution().executedPlan().toString()  # 300 documents, 9 items
    got = {r["item"]: r.first_rank for r in ranks.collect()}
    for i in range(9):
        order = sorted((hashlib.md5(f"7:{i}:{d * 3}".encode()).hexdigest(), d * 3) for d in range(300))
        assert got[i] == 1 + min(k for k, (_, d) in enumerate(order) if (i, d) in positives)
