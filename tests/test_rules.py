"""Rules with fixed expected values: compaction, retries, gates, decisions, manifests, persistence, seals, seeded draws."""

import difflib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rankspark.functions import hashing as H
from rankspark.functions import scoring as S
from rankspark.functions import text as T
from rankspark.operators import audit, cohort, ledger, manifest, persist, randomized, ranking, scorer, seal, stats, windows
from rankspark.plans import regenerate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_short_sources_stay_whole():
    text = "\n".join(f"line {i}" for i in range(240))
    c = windows.compact_source(text, ["nothing"])
    assert c["mode"] == "full" and "\n".join(c["lines"]) == text and c["ranges"] == [(0, 240)]


def test_long_sources_keep_header_and_best_windows():
    lines = [f"filler {i}" for i in range(500)]
    lines[300] = "needle haystackItem needle"
    c = windows.compact_source("\n".join(lines), ["needle", "haystack"])
    # windows start every 60 lines; 240-320 and 300-380 hold the line, and the earlier one wins with as many new lines
    assert c["mode"] == "windows" and c["windows"] == 8 and [w[:2] for w in c["picked"]][1:] == [(240, 320), (300, 380)]
    # the third has score 0: the earliest window with a new line, of which the header holds 40; the cap cuts nothing here
    assert c["picked"][0][:2] == (0, 80) and c["ranges"] == [(0, 80), (240, 380)]
    assert c["lines"].count(windows.OMITTED) == 2 and c["lines"][80] == windows.OMITTED and c["lines"][-1] == windows.OMITTED
    assert sum(b - a for a, b in c["ranges"]) <= windows.MAX_LINES


def test_the_window_without_new_lines_does_not_count():
    lines = [f"x{i}" for i in range(241)]
    c = windows.compact_source("\n".join(lines), ["x5"])
    assert len(c["picked"]) == 3 and sum(b - a for a, b in c["ranges"]) == 220 and c["ranges"] == [(0, 200), (220, 240)] or c["ranges"][0][0] == 0


def test_compaction_in_spark(spark):
    rows = [(1, "a\r\nb", ["a"]), (2, None, None), (3, "\n".join(f"l{i}" for i in range(300)), ["l250"])]
    got = {r.k: r for r in windows.compact_sources(spark.createDataFrame(rows, "k long, t string, q array<string>"), "k", "t", "q").collect()}
    assert (got[1].mode, got[1].compact, got[1].n_lines) == ("full", "a\nb", 2) and got[2].compact == "" and got[3].mode == "windows" and "l250" in got[3].compact.split("\n")


@pytest.mark.parametrize("message, status, wait, retry", [
    ("HTTP 400 bad request", 400, None, False), ("HTTP 429 rate limit", 429, None, True), ("HTTP 503", 503, None, True), ("HTTP Error 429", None, None, False), ("HTTP 999", 999, None, False),
    ("HTTP 404: gateway timed out", 404, None, False), ("connection timed out", None, None, True), ("HTTP 500 'retry-after': '7.5'", 500, 7.5, True), ("Retry-After=3", None, 3.0, False)])
def test_messages(spark, message, status, wait, retry):
    m = F.lit(message)
    assert (one(spark, T.http_status(m)), one(spark, T.retry_after_seconds(m)), one(spark, T.is_retryable(m))) == (status, wait, retry)


def failing(times, **error):
    left = [times]

    def call(payload):
        if left[0]:
            left[0] -= 1
            raise scorer.ScoringError(error.get("message", "HTTP 503"), error.get("status", 503), error.get("retry_after"))
        return 0.5

    return call


def test_retries_follow_the_rule():
    slept = []
    assert scorer.with_retries(lambda: failing_once(None), sleep=slept.append) == 0.5 and slept == [5.0]
    for e, n in ((scorer.ScoringError("HTTP 400", 400), 0), (scorer.ScoringError("timeout"), 3), (scorer.ScoringError("HTTP 404: timed out", 404), 0), (scorer.ScoringError("HTTP 529", 529), 3)):
        slept = []

        def call(e=e):
            raise e

        with pytest.raises(scorer.ScoringError):
            scorer.with_retries(call, sleep=slept.append)
        assert slept == [1.0, 2.0, 4.0][:n]


failing_once = failing(1, status=429, retry_after=5.0)


def test_batches_share_calls_and_keep_their_order():
    seen = []

    def call(x):
        seen.append(x)
        return x * 2

    out = scorer.run_batch([("a", 1, 0.0), ("b", 2, 0.0), ("a", 3, 0.0), ("c", 4, 0.0)], call, concurrency=3)
    assert [o.result for o in out] == [2, 4, 2, 8] and sorted(seen) == [1, 2, 4] and all(o.attempts == 1 for o in out)


def test_the_spend_gate_reserves_and_settles():
    gate = scorer.SpendGate(1.0)
    out = scorer.run_batch([(i, i, c) for i, c in enumerate((0.6, 0.6, 0.4, 0.1))], lambda x: x, concurrency=1, spend=gate, actual=lambda x: 0.5 if x == 0 else None)
    # 0.6 is reserved and settled at 0.5; 0.6 more would be 1.1 and reserves nothing; 0.4 and 0.1 fit
    assert [o.status.split(":")[0] for o in out] == ["ok", "skipped", "ok", "ok"] and gate.spent == pytest.approx(1.0)
    gate = scorer.SpendGate(1.0)
    out = scorer.run_batch([("x", 0, 0.4)], failing(9), concurrency=1, spend=gate, sleep=lambda s: None)
    assert out[0].status.startswith("skipped") and out[0].attempts == 2 and gate.spent == pytest.approx(0.8)  # failed tries keep their reservations
    with pytest.raises(ValueError):
        scorer.SpendGate(float("nan"))


def test_the_rate_gate_waits_for_the_window():
    now = [0.0]
    gate = scorer.RateGate(2, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    began = []
    for _ in range(5):
        gate.wait()
        began.append(now[0])
    assert began == [0.0, 0.0, 60.0, 60.0, 120.0]


def test_scorer_in_spark(spark):
    pairs = spark.createDataFrame([(i, f"k{i % 4}", f"state {i % 4}", "state of things") for i in range(8)], "i int, cache_key string, state string, question string")
    cache = spark.createDataFrame([("k0", 0.25)], "cache_key string, score double")
    got = {r.i: (r.score, r.status) for r in scorer.score_shortlist(pairs, cache, lambda s, q: 2.0 if s.endswith("3") else scorer.overlap_scorer(s, q), max_concurrency=2).collect()}
    assert got[0] == got[4] == (0.25, "cached") and got[1] == (pytest.approx(1 / 3), "ok") and got[3] == (None, "out of range")
    out = scorer.embed_texts(spark.createDataFrame([(i, "x" * i) for i in range(5)], "i int, t string").coalesce(1), "i", "t", lambda t: [[float(len(x)), float(len(t))] for x in t], size=2)
    assert sorted((r.i, r.embedding) for r in out.collect()) == [(0, [0.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [3.0, 2.0]), (4, [4.0, 1.0])]


def test_spend_of_a_ledger(spark):
    rows = [("a", 1, 0.9), ("a", 2, 5.0), ("a", 3, 0.1), ("a", 4, 0.1), ("b", 5, None), ("b", 6, 1.0)]
    got = {r.seq: (r.spent, r.allowed) for r in ledger.running_spend(spark.createDataFrame(rows, "bug string, seq long, usd double"), "bug", "seq", "usd", 1.0).collect()}
    assert got == {1: (0.9, True), 2: (0.9, False), 3: (1.0, True), 4: (1.0, False), 5: (0.0, True), 6: (1.0, True)}


@pytest.mark.parametrize("case, want", [((0.80, 0.70, 0.90, 0.25), (True, "alternative_1")), ((0.90, 0.88, 0.91, 0.5), (False, "none")), ((0.90, 0.88, 0.91, 0.25), (True, "alternative_2"))])
def test_decisions(spark, case, want):
    r = cohort.practical_success(spark.createDataFrame([case], "f double, b double, p double, c double"), *[F.col(c) for c in "fbpc"]).first()
    assert (r.success, r.via) == want


def test_manifest_and_lock(spark):
    m = spark.createDataFrame([("development", i, f"Cli-{i}") for i in (3, 1, 2)] + [("evaluation", 9, "Lang-9")], "split string, position long, id string")
    rows = manifest.seeds(manifest.split_rows(m, "development", {"development": 3, "evaluation": 1}), 1337)
    assert [(r.id, r["index"], r.seed) for r in rows.orderBy("index").collect()] == [("Cli-1", 0, 1337), ("Cli-2", 1, 1338), ("Cli-3", 2, 1339)]
    with pytest.raises(ValueError):
        manifest.split_rows(m, "development", {"development": 25, "evaluation": 125})
    asked = spark.createDataFrame([("Lang-9",), ("Cli-1",), ("No-1",)], "id string")
    lock = lambda *r: spark.createDataFrame([r], "tag string, validated boolean, commit_sha string")
    assert [r.id for r in manifest.membership(asked, m).collect()] == ["Cli-1"]
    assert sorted(r.id for r in manifest.membership(asked, m, lock(manifest.LOCK_TAG, True, "abc"), True).collect()) == ["Cli-1", "Lang-9"]
    for bad in (None, lock("other", True, "abc"), lock(manifest.LOCK_TAG, False, "abc"), lock(manifest.LOCK_TAG, True, "")):
        with pytest.raises(PermissionError):
            manifest.membership(asked, m, bad, True)
    ids = manifest.by_id(spark.createDataFrame([("Math-10",), ("Math-9",), ("Cli-2",)], "q string"), "q")
    assert [r.q for r in ids.orderBy("position").collect()] == ["Cli-2", "Math-9", "Math-10"]
    arms = manifest.arm_ranks(spark.createDataFrame([("gain", 3), ("gain", 5), ("loss", -1)], "arm string, delta int"), "arm", F.col("delta").desc())
    assert sorted((r.arm, r.delta, r.arm_rank) for r in arms.collect()) == [("gain", 3, 2), ("gain", 5, 1), ("loss", -1, 1)]


def test_shortlists_are_written_reused_regenerated_or_locked(spark, tmp_path):
    path = f"file://{tmp_path}/short"
    built = lambda *r: spark.createDataFrame(list(r), "item long, sha256 string, signature string")
    locks = spark.createDataFrame([(2,)], "item long")
    out = lambda *a, **k: {r["item"]: r["outcome"] for r in persist.save_shortlists(*a, **k).collect()}
    assert out(built((1, "a", "s"), (2, "b", "s")), path, locks.limit(0)) == {1: "written", 2: "written"}
    assert out(built((1, "a", "s"), (2, "b", "s")), path, locks) == {1: "reused", 2: "reused"}
    with pytest.raises(PermissionError):
        persist.save_shortlists(built((1, "c", "s"), (2, "b2", "s")), path, locks)
    assert sorted(r.sha256 for r in persist.load_shortlists(spark, path).collect()) == ["a", "b"]
    assert out(built((2, "b2", "s2")), path, locks, force=True) == {2: "regenerated"}
    assert sorted(r.sha256 for r in persist.load_shortlists(spark, path).collect()) == ["a", "b2"]


def test_rankings_are_reused_by_their_signature(spark, tmp_path):
    calls = []

    def rank(todo):
        calls.append(sorted(r["item"] for r in todo.collect()))
        return todo.withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({"doc": F.col("rank"), "score": F.lit(0.5), "n": F.lit(2)}).select("item", "signature", "doc", "rank", "score", "n")

    wanted = lambda *r: spark.createDataFrame(list(r), "item long, signature string")
    path = f"file://{tmp_path}/ranked"
    assert persist.cached_ranking(wanted((1, "x"), (2, "y")), path, rank).count() == 4
    assert persist.cached_ranking(wanted((1, "x"), (2, "z")), path, rank).count() == 4 and calls == [[1, 2], [2]]
    spark.createDataFrame([(3, "w", 1, 1, float("nan"), 1)], "item long, signature string, doc int, rank int, score double, n int").write.mode("append").parquet(path)
    assert persist.cached_ranking(wanted((3, "w")), path, rank).count() == 0 or calls[-1] == [3]  # a damaged entry is ranked again


def test_signatures_see_every_input(spark):
    queries = spark.createDataFrame([(1, "find parser")], "item long, query string")
    inventory = spark.createDataFrame([(1, i, f"C{i}") for i in range(3)], "item long, position long, doc string")
    texts = lambda *t: spark.createDataFrame([(f"C{i}", x) for i, x in enumerate(t)], "doc string, text string")
    sign = lambda q, i, t: persist.input_signature(persist.lexical_inputs(q, i, t)).first()["signature"]
    a = sign(queries, inventory, texts("x", "y", "z"))
    assert a == sign(queries, inventory, texts("x", "y", "z")) and len(a) == 64
    assert len({a, sign(queries, inventory, texts("x", "y", "zz")), sign(queries.withColumn("query", F.lit("q")), inventory, texts("x", "y", "z")), sign(queries, inventory.filter("position < 2"), texts("x", "y", "z"))}) == 4
    rows = persist.lexical_inputs(queries, inventory, texts("x").unionByName(texts().limit(0)) if False else texts("x", "y")).orderBy("position").collect()
    assert [(r.document, r.source_missing) for r in rows] == [("C0\nx", False), ("C1\ny", False), ("C2", True)]


def test_a_seal_needs_empty_checks(spark):
    index = spark.createDataFrame([("p", "1")], "path string, sha256 string")
    assert seal.seal({"hashes": seal.hash_violations(index, index)}, index).count() == 1
    with pytest.raises(ValueError):
        seal.seal({"hashes": seal.hash_violations(index, index.withColumn("sha256", F.lit("2")))}, index)
    docs = spark.createDataFrame([("a", "c1"), ("b", None), ("c", "c2")], "path string, experiment_commit string")
    assert sorted(r.path for r in seal.commit_violations(docs, "c1").collect()) == ["b", "c"]


def test_seeded_draws_are_those_of_the_library(spark):
    rows = [(s, f"{s}{i}") for s in "BA" for i in (10, 9, 2, 1)]
    got = randomized.mersenne_sample(spark.createDataFrame(rows, "s string, id string"), "s", "id", ["A", "B"], 42, 3, 1).collect()
    rng = random.Random(42)
    want = [(s, x, i, "development" if i < 1 else "evaluation") for s in "AB" for i, x in enumerate(rng.sample(sorted(r[1] for r in rows if r[0] == s), 3))]
    assert sorted((r.stratum, r.id, r.position, r.split) for r in got) == sorted(want)
    df = spark.createDataFrame([(7, f"C{i:02}", 3, i == 4) for i in range(20)], "item long, cls string, seed_index long, good boolean")
    m = randomized.permutation_metrics(df, "item", "cls", "good", 1_001_337, 1000).first()
    rng, ranks = random.Random(1_001_340), []
    for _ in range(1000):
        order = [f"C{i:02}" for i in range(20)]
        rng.shuffle(order)
        ranks.append(order.index("C04") + 1)
    assert m.mean_rank == pytest.approx(statistics.mean(ranks)) and m.rr == pytest.approx(statistics.mean(1 / r for r in ranks)) and m.fdr10 == pytest.approx(statistics.mean(r <= 2 for r in ranks))
    prints = randomized.permutations(df, "item", "cls", 1337, 5).orderBy("permutation").collect()
    import hashlib

    rng = random.Random(1340)
    for r in prints:
        order = [f"C{i:02}" for i in range(20)]
        rng.shuffle(order)
        assert r.sha256 == hashlib.sha256("\0".join(order).encode()).hexdigest()


def test_bootstrap_draws_are_those_of_the_library(spark):
    pairs = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(10)], "pos long, a double, b double")
    got = {r.sample: r.delta for r in stats.bootstrap_delta(stats.mersenne_draws(spark, 10, 450, 5), pairs, "a", "b").collect()}
    rng = random.Random(5)
    for s in range(450):
        assert got[s] == pytest.approx(sum(rng.randrange(10) % 2 for _ in range(10)) / 10)


def test_diffs_join_in_the_order_of_their_paths(spark):
    rows = [("b.java", "one\ntwo\n", "one\n2\n"), ("a.java", "x\n", "x"), ("c.java", "same\n", "same\n")]
    d = windows.unified_diff(spark.createDataFrame(rows, "path string, fixed string, buggy string"), "path", "fixed", "buggy")
    per = {r.path: r.diff for r in d.collect()}
    assert per["b.java"] == "".join(difflib.unified_diff(["one\n", "two\n"], ["one\n", "2\n"], "a/b.java", "b/b.java")) and "-two\n+2\n" in per["b.java"] and per["c.java"] == ""
    whole = windows.full_diff(d.withColumn("bug", F.lit(1)), ["bug"], "path", "diff").first().diff
    assert whole == per["a.java"] + per["b.java"] + ("" if (per["a.java"] + per["b.java"]).endswith("\n") else "\n") and whole.index("a.java") < whole.index("b.java")


def test_small_helpers(spark):
    assert H.private_fields(["x", "labels", "positive_classes"]) == ["labels", "positive_classes"]
    assert one(spark, ranking.ranking_ids(F.lit(None).cast("array<string>"), F.array(F.struct(F.lit("C1").alias("test_class"))))) == ["C1"]
    assert one(spark, T.relative_dir(F.lit(" src/test "))) == "src/test" and one(spark, T.relative_dir(F.lit("/abs"))) is None and one(spark, T.relative_dir(F.lit("a\nb"))) is None
    assert one(spark, S.scores_agree(F.lit(0.5), F.lit(0.5 + 1e-13))) and not one(spark, S.scores_agree(F.lit(0.5), F.lit(0.6)))
    assert one(spark, S.workload_usd(F.lit(100), F.lit(200), F.lit(1000.0), F.lit(0.042), F.lit(0.055))) == pytest.approx(100 * 200 * 1000 * 0.042 / 1e6 * 1.055)
    assert [one(spark, f(F.lit(x).cast("double"))) for f, x in ((T.format_usd, 0.0138779), (T.format_rate, 0.95575), (T.format_percent, 0.2212), (T.format_usd, None))] == ["0.013878", "0.9557", "22.1%", "—"]
    assert [(r.a, r.n) for r in audit.duplicate_keys(spark.createDataFrame([(1,), (1,), (2,)], "a int"), ["a"]).collect()] == [(1, 2)]
    assert math.isclose(one(spark, S.percentage_points(F.lit(0.2212))), 22.12)


def test_containing_finds_passages_of_any_length(spark):
    from rankspark.operators import lexical as L

    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "alpha betagamma delta"), (3, "xalpha beta gamma deltas"), (4, None), (5, "one")], "doc long, body string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "beta"), (3, "a b"), (4, None), (5, "gamma delta epsilon zeta"), (6, "? !")], "item long, text string")
    post = L.postings(L.token_frame(docs.withColumnRenamed("body", "text"), "doc", "text"), L.query_terms(items, "item", "text"))
    got = sorted((r["item"], r.doc) for r in L.containing(post, items, docs).collect())
    want = sorted((i.item, d.doc) for i in items.collect() for d in docs.collect() if i.text is not None and d.body is not None and i.text in d.body)
    assert got == want and (1, 3) in got


def test_everything_is_made_again_and_agrees(spark, tmp_path):
    out = regenerate.regenerate(spark, "/root/testdata/sf0.001", f"file://{tmp_path}/out")
    assert set(out) == set(regenerate.STEPS) and out["metrics"].filter("available").count() == 2 * out["nftr_cdf"].filter("method = 'BM25'").count()
