"""Queries do the whole job: nothing is left out at any table size."""

from rankspark.plans import ledger, retrieval


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_scorer_map_scores_every_question_against_every_passage(spark, tmp_path):
    items = [(i, f"passage {i} of words") for i in range(12)]
    turns = [(c, t, "user", f"question {c} of turn {t}") for c in range(30) for t in range(2)]
    d = saved(spark, tmp_path, benchmark=(items, "item_id long, text string"), conversations=(turns, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r["item"]): r for r in ledger.scorer_map(spark, d).collect()}
    assert set(got) == {(c, i) for c in range(30) for i in range(12)}
    assert all(r.status == ("cached" if i < 5 else "ok") and r.score is not None for (_, i), r in got.items())


def test_rank_permutation_audit_sees_the_whole_ranking(spark, tmp_path, monkeypatch):
    d = saved(spark, tmp_path, benchmark=([(1, "a")], "item_id long, text string"), documents=([(i, "x") for i in range(10)], "doc_id long, text string"))
    docs = [0, 1, 2, 3, 4, 5, 6, 7, 7, 99]  # 8 and 9 are lost from ranks 9 and 10, 7 comes twice, 99 is unknown
    monkeypatch.setattr(retrieval, "full_ranking", lambda s, _: s.createDataFrame([(1, x, n + 1, 0.0) for n, x in enumerate(docs)], "item long, doc long, rank long, score double"))
    got = {(r.rule, r.doc_id) for r in retrieval.rank_permutation_audit(spark, d).collect()}
    assert got == {("missing", 2), ("missing", 8), ("missing", 9), ("repeated", 7), ("unknown", 99), ("ranks", None)}
