"""What grows with the input stays out of shuffles, and out of single tasks."""

from pyspark.sql import functions as F

from rankspark.plans import evaluation


def test_repeated_vectors_are_counted_where_they_are_made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluation, "REPS", 20)
    rows = [(i, i // 9 % 3 if i % 11 else None) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = evaluation.replicates(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # that of the counts
    import hashlib
    digest = lambda s, label, i: (hashlib.md5(f"{s}:{label}:{i}".encode()).hexdigest(), i)
    got = {(r.replicate, r.label): (r.first_rank, r.n) for r in evaluation.replicates(spark, str(tmp_path)).collect()}
    for s in range(20):
        for label in range(3):
            ids = sorted((digest(s, label, i) for i, x in rows if x == label))
            assert got[s, label] == (1 + [i % 9 for _, i in ids].index(0), len(ids))
    assert len(got) == 60


def test_calls_come_in_waves_of_bounded_tasks(spark, monkeypatch):
    from rankspark.operators import scorer

    wanted = spark.range(400).select(F.concat(F.lit("k"), F.col("id") % 300).alias("cache_key"), F.lit("a b").alias("state"), F.concat(F.lit("a "), F.col("id") % 300).alias("question"))
    cache = spark.createDataFrame([("k7", 0.5)], "cache_key string, score double")
    rows = lambda: sorted(tuple(r) for r in scorer.score_misses(wanted, cache, scorer.overlap_scorer, max_concurrency=2).collect())
    want = rows()
    monkeypatch.setattr(scorer, "TASK_BYTES", 500)
    sizes = []
    kept = scorer.cut
    monkeypatch.setattr(scorer, "cut", lambda df: sizes.append(1) or kept(df))
    assert rows() == want and len(want) == 299 and len(sizes) - 2 >= 299 * 10 / (2 * 500)


def test_no_text_is_written_once_for_each_of_its_pairs(spark, monkeypatch):
    from rankspark.operators import scorer

    states = spark.createDataFrame([(i, f"a {i} " + "x" * 50) for i in range(20)] + [(20, None), (21, "")], "s int, state string")
    pairs = spark.range(60).select((F.col("id") % 50).alias("q"), F.concat(F.lit("a "), F.col("id") % 50).alias("question")).crossJoin(states).withColumn("cache_key", F.concat_ws("|", "s", "q"))
    cache = spark.createDataFrame([("3|7", 0.5)], "cache_key string, score double")
    written, kept = [], scorer.cut
    monkeypatch.setattr(scorer, "cut", lambda df: written.append(kept(df)) or written[-1])
    want = {f"{s}|{q}": scorer.overlap_scorer(t, f"a {q}") for s, t in states.collect() for q in range(50)} | {"3|7": 0.5}
    for limit, options in ((scorer.TEXT_BYTES, {}), (scorer.TEXT_BYTES, {"ids": ("s", "q")}), (0, {"ids": ("s", "q")}), (0, {})):
        monkeypatch.setattr(scorer, "TEXT_BYTES", limit)  # 0: texts are not broadcast
        got = scorer.score_shortlist(pairs, cache, scorer.overlap_scorer, max_concurrency=2, **options).collect()
        assert len(got) == 60 * 22 and all(r.score == want[r.cache_key] for r in got)
    assert all(df.count() <= 50 for df in written if {"state", "question"} & set(df.columns)) and max(df.count() for df in written) == 1_099


def test_first_ranks_in_blocks_are_those_of_all_pairs(spark):
    import numpy as np

    from rankspark.operators import vectors

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)], int(rng.integers(0, 9)) if i % 8 else None) for i in range(300)] + [(300, None, 1), (301, [0.0] * 6, 1), (302, [float("nan")] * 6, 1), (303, [1.0] * 5, 1), (304, [2.0] * 5, 1), (310, [1.0] * 6, 77)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(4)
    q = df.filter("id % 5 = 0 or id = 303").select(F.col("id").alias("item"), F.col("v").alias("qv"), F.col("label").alias("own"))
    got = {r["item"]: (r.first_rank, r.n) for r in vectors.first_ranks(q, df.select(F.col("id").alias("doc"), "v", "label"), block=32).collect()}
    ok = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if v and np.isfinite(v).all() and any(v)]
    want = {}
    for i, v, own in ok:
        if i % 5 == 0 or i == 303:
            order = sorted((-round(float(v @ w), 9), j, label) for j, w, label in ok if j != i and len(w) == len(v))
            good = [k for k, (_, _, label) in enumerate(order, 1) if own is not None and label == own]
            if good:
                want[i] = (good[0], len(order))
    assert got == want and 303 in got and 310 not in got


def test_audits_group_their_rows_once(spark):
    from rankspark.operators import predictions, ranking

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    ranked = spark.range(70_000).select(F.lit(1).alias("item"), F.col("id").alias("doc"), F.when(F.col("id") == 40_000, 5).otherwise(F.col("id") + 1).alias("rank"))
    bad = ranking.permutation_violations(ranked, ranked.filter("doc <> 9"), ["item"], "doc")
    assert "distinct" not in plan(bad).lower() and "FullOuter" not in plan(bad)
    assert {(r.rule, r.doc) for r in bad.collect()} == {("unknown", 9), ("ranks", None)}
    schema = "method string, qualified_id string, test_class string, score double, score_applicable boolean, inapplicable_reason string"
    rows = spark.createDataFrame([("m", "a", x, 0.5, True, None) for x in "xyyzz"] + [("m", "a", "w", None, True, None)], schema)
    bad = predictions.prediction_violations(rows, spark.createDataFrame([("a", x) for x in "xyuw"], "qualified_id string, test_class string"))
    assert "LeftAnti" not in plan(bad)
    assert sorted((r.rule, r.test_class) for r in bad.collect()) == [("duplicate key", "y"), ("duplicate key", "z"), ("missing class", "u"), ("no score", "w"), ("unknown class", "z"), ("unknown class", "z")]


def test_rows_that_agree_with_the_inventory_are_not_grouped_by_key(spark):
    from rankspark.operators import predictions

    n = 20_000
    rows = spark.range(n).select(F.lit("m").alias("method"), F.lit("a").alias("qualified_id"), F.concat(F.lit("C"), "id").alias("test_class"), F.lit(0.5).alias("score"), F.lit(True).alias("score_applicable"), F.lit(None).cast("string").alias("inapplicable_reason"))
    inventory = rows.select("qualified_id", "test_class").unionByName(spark.createDataFrame([("a", "lost")], "qualified_id string, test_class string"))
    damaged = rows.unionByName(rows.filter("test_class = 'C7'")).unionByName(rows.filter("test_class = 'C8'").withColumn("test_class", F.lit("odd")))
    found = lambda **kw: predictions.prediction_violations(damaged, inventory, **kw)
    want = [("duplicate key", "C7"), ("missing class", "lost"), ("unknown class", "odd")]
    got = found(listed_once=True)
    assert sorted((r.rule, r.test_class) for r in got.collect()) == sorted((r.rule, r.test_class) for r in found().collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2  # of the rows and of the inventory


def test_rows_without_a_cache_key_are_not_joined(spark):
    from rankspark.operators import predictions

    ranked = spark.createDataFrame([("x", 1, 0.5, 1, False, "k", True), *[(f"t{i}", i, None, i, False, None, False) for i in range(2, 50)]], "test_class string, rank long, score double, bm25_rank long, source_missing boolean, cache_key string, scored boolean")
    cache = spark.createDataFrame([("k", 0.5, "p", "m", "o", "v", "u", 3.0, "b", "r")], "cache_key string, score double, provider string, model_id string, observed_model_id string, prompt_version string, usage string, latency_ms double, price_basis string, provider_request_id string")
    rows = predictions.prediction_rows(ranked, cache, method="m", qualified=F.lit("q"), slug=F.lit("s"), commit="c", run_id="r", path=F.lit("p"), scored=F.col("scored"))
    assert "isnotnull(cache_key" in rows._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]  # above the join's left side
    got = rows.collect()
    assert len(got) == 49 and [(r.test_class, r.provider, r.latency_ms) for r in got if r.provider] == [("x", "p", 3.0)]


def test_one_row_group_is_not_one_task(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from rankspark.sources.tables import spread

    rows = pa.table({"doc_id": pa.array(range(8_000)), "text": [f"w{i * 7919 % 8_009} " * (i % 40) for i in range(8_000)]})
    confs = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    for name, size in (("one", 8_000), ("many", 250)):
        pq.write_table(rows, f"{tmp_path}/{name}.parquet", row_group_size=size)
    by_task = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        for key in ("doc_id", None):
            df = spark.read.parquet(f"{tmp_path}/one.parquet")
            assert df.rdd.getNumPartitions() >= 8 and by_task(df) == [8_000]  # pieces enough, but one holds all rows
            assert max(by_task(spread(df, key=key))) < 2 * 8_000 / 8
            assert spread(df, key=key).agg(F.sum("doc_id"), F.count("text")).first() == (sum(range(8_000)), 8_000)
        even = spark.read.parquet(f"{tmp_path}/many.parquet")
        assert spread(even) is even
        assert spread(even.filter("doc_id < 0")).count() == 0
    finally:
        for k in confs:
            spark.conf.unset(k)


def test_draws_are_dealt_out_by_sample(spark):
    import hashlib

    from rankspark.operators import stats

    pairs = spark.range(30).select(F.col("id").alias("pos"), F.lit(30).cast("long").alias("n"), (F.col("id") * 2).alias("value")).coalesce(1)
    drawn = stats.hash_draws(64, pairs, 9)
    assert "CartesianProduct" not in drawn._jdf.queryExecution().executedPlan().toString()
    rows = drawn.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) >= 8  # one when each pair drew for all samples
    draw = lambda s, p: int(hashlib.md5(f"9:{s}:{p}".encode()).hexdigest()[:8], 16) % 30
    assert sorted((r.sample, r.pos, r.value) for r in rows) == sorted((s, draw(s, p), 2 * draw(s, p)) for s in range(64) for p in range(30))
