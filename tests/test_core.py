import pytest
from compare import oracle, same
from pyspark.sql import functions as F

from rankspark import plans
from rankspark.functions import scoring as S
from rankspark.functions import text as T
from rankspark.operators import metrics, ranking

SF = "/root/testdata/sf0.001"
FAST = ["manifest_split", "manifest_audit", "membership", "id_sort", "ordered_lookup", "ordered_lookup_audit", "annotation_audit", "tokenizer_fingerprint", "lexical_inputs", "ranking_cache_plan", "shortlist_persistence", "sealed_input_audit", "raw_seal_audit", "seal_hash_audit",
        "consistency_audit", "score_entry_audit", "embedding_entry_audit", "formats", "workload_cost", "ledger_running_spend", "ledger_settled_spend", "ledger_usage_sets", "list_digests", "example_lifecycle", "manifest_drift", "resolution_counts", "prediction_audit", "bm25_first_positive_rank", "metrics_table",
        "tok_documents", "bm25_scores_top20", "budget_k_grid", "practical_success", "ledger_dedupe_first", "ledger_equal_share", "ledger_wave_wall", "ledger_rolling_60s", "interval_islands", "id_parse", "source_resolution", "http_status_parse", "key_reconcile_full_outer"]


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, name):
    ok, why = same(spark, oracle(SF), SF, plans.queries()[name], plans.oracle_sql()[name])
    assert ok, why


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("parseHTTPResponse_v2", "parse http response v2"), ("test123Name", "test123 name"), ("XMLHttpRequest", "xml http request"), ("a if for the class", "if for the class"), (None, "")])
def test_tokens(spark, text, want):
    assert " ".join(one(spark, T.tokenize(F.lit(text).cast("string")))) == want


@pytest.mark.parametrize("b, c, p", [(0, 0, 1.0), (5, 0, 1 / 16), (3, 1, 0.625), (28, 3, 4.649162292480469e-06)])
def test_mcnemar(spark, b, c, p):
    assert one(spark, S.mcnemar_exact(F.lit(b).cast("long"), F.lit(c).cast("long"))) == pytest.approx(p)


def test_truncation_keeps_the_cap(spark):
    assert len(one(spark, T.truncate_middle(F.lit("x" * 12_150)))) == 12_000


def test_metrics_limits(spark):
    r = metrics.item_metrics(spark.createDataFrame([(1, 10), (10, 10)], "first_rank long, n long")).orderBy("first_rank").collect()
    assert [(x.rr, x.nftr, x.apfd) for x in r] == [(1.0, 0.1, pytest.approx(0.95)), (0.1, 1.0, pytest.approx(0.05))]


def test_rerank_keeps_the_tail(spark):
    base = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcde", 1)], "item long, doc string, base_rank long")
    scores = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.1), (1, "c", 0.9)], "item long, doc string, ext_score double")
    out = ranking.rerank(base, scores, ["item"], "doc", 3).orderBy("rank").collect()
    assert "".join(r.doc for r in out) == "cabde" and ranking.rerank_violations(base, scores, ["item"], "doc", 3).isEmpty()
