"""Manifest, lookup, prediction, persistence and seal queries: each over whole tables, damaged in stated places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, manifest, metrics, persist, predictions, ranking, seal
from ..sources.tables import table
from . import evaluation as E
from . import retrieval as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


MANIFEST = "man AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN 'development' ELSE 'evaluation' END AS split, c_custkey AS position, replace(c_mktsegment, ' ', '') || '-' || c_custkey AS id FROM customer)"


def customers(spark, d) -> DataFrame:
    """(split, position, id): a manifest that lists every sixth customer for development."""
    split = F.when(F.col("c_custkey") % 6 == 0, "development").otherwise("evaluation")
    return table(spark, d, "customer").select(split.alias("split"), F.col("c_custkey").alias("position"), F.concat(F.replace("c_mktsegment", F.lit(" "), F.lit("")), F.lit("-"), "c_custkey").alias("id"))


@query(f"WITH {MANIFEST} SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY position) - 1 AS index, CASE split WHEN 'development' THEN 1337 ELSE 1001337 END + row_number() OVER (PARTITION BY split ORDER BY position) - 1 AS seed FROM man")
def manifest_split(spark, d):
    """Both splits in manifest order with their seeds."""
    m = customers(spark, d)
    part = lambda split, base: manifest.seeds(manifest.split_rows(m, split), base).select(F.lit(split).alias("split"), "id", "index", "seed")
    return part("development", 1337).unionByName(part("evaluation", 1_001_337))


@query(f"""WITH {MANIFEST}, dam AS (SELECT * FROM man UNION ALL SELECT split, position, id FROM man WHERE position % 40 = 1 UNION ALL SELECT CASE split WHEN 'development' THEN 'evaluation' ELSE 'development' END, position, id FROM man WHERE position % 50 = 2),
i AS (SELECT id, count(*) AS n, count(DISTINCT split) AS splits FROM dam GROUP BY 1), w AS (SELECT * FROM (VALUES ('development', 25), ('evaluation', 125)) t(split, want))
SELECT CASE WHEN splits > 1 THEN 'overlap' ELSE 'duplicate' END AS rule, id, n FROM i WHERE n > 1 UNION ALL
SELECT 'size', w.split, coalesce(c.n, 0) FROM w LEFT JOIN (SELECT split, count(*) AS n FROM dam GROUP BY 1) c USING (split) WHERE coalesce(c.n, 0) <> want""")
def manifest_audit(spark, d):
    """A manifest that lists some ids twice and some in both splits, against the locked sizes."""
    m = customers(spark, d)
    other = F.when(F.col("split") == "development", "evaluation").otherwise("development")
    damaged = m.unionByName(m.filter("position % 40 = 1")).unionByName(m.filter("position % 50 = 2").withColumn("split", other))
    return manifest.manifest_violations(damaged, {"development": 25, "evaluation": 125})


ORDERS = "o AS (SELECT o_orderkey, replace(c_mktsegment, ' ', '') || '-' || c_custkey AS id FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {MANIFEST}, {ORDERS} SELECT o_orderkey, split, id FROM o JOIN man USING (id) WHERE split = 'development'")
def membership(spark, d):
    """Orders of development customers; the evaluation split stays shut without a lock."""
    m = customers(spark, d)
    rows = table(spark, d, "orders").join(m.select(F.col("position").alias("o_custkey"), "id"), "o_custkey").select("o_orderkey", "id")
    return manifest.membership(rows, m).select("o_orderkey", "split", "id")


@query(f"WITH {MANIFEST} SELECT id, row_number() OVER (ORDER BY split_part(id, '-', 1), CAST(split_part(id, '-', 2) AS BIGINT)) AS position FROM man")
def id_sort(spark, d):
    return manifest.by_id(customers(spark, d).select("id"), "id")


TURNS = "inv AS (SELECT conv_id, turn AS position, role || turn AS key FROM conversations), txt AS (SELECT conv_id, role || turn AS key, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS text FROM conversations WHERE (conv_id + turn) % 7 <> 0)"


def turn_lookup(spark, d) -> DataFrame:
    """Each conversation's turns in order with their texts; one in seven is lost, some are empty."""
    c = table(spark, d, "conversations").withColumn("key", F.concat("role", "turn"))
    texts = c.filter("(conv_id + turn) % 7 <> 0").withColumn("text", F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text")))
    return manifest.ordered_lookup(c.select("conv_id", F.col("turn").alias("position"), "key"), texts, ["conv_id"], "key", "text")


@query(f"WITH {TURNS} SELECT conv_id, position, key, md5(nullif(text, '')) AS text_md5 FROM inv LEFT JOIN txt USING (conv_id, key)")
def ordered_lookup(spark, d):
    return turn_lookup(spark, d).select("conv_id", "position", "key", F.md5("text").alias("text_md5"))


@query(f"WITH {TURNS} SELECT 'no text' AS rule, conv_id, key FROM inv LEFT JOIN txt USING (conv_id, key) WHERE nullif(text, '') IS NULL")
def ordered_lookup_audit(spark, d):
    return manifest.lookup_violations(turn_lookup(spark, d), ["conv_id"], "key", "text")


NOTES = """sel AS (SELECT n_nationkey AS key, n_nationkey + 1 AS position FROM nation), nt AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey IN (3, 4) THEN 8 - n_nationkey ELSE n_nationkey + 1 END AS position,
CASE WHEN n_nationkey = 7 THEN 'odd' ELSE 'lexical' END AS category, CASE WHEN n_nationkey = 9 THEN ' ' ELSE n_name END AS evidence FROM nation WHERE n_nationkey <> 11 UNION ALL SELECT 99, 99, 'lexical', 'x')"""


@query(f"""WITH {NOTES}, j AS (SELECT key, s.position AS p, n.position AS q, category, evidence FROM sel s FULL JOIN nt n USING (key)),
r AS (SELECT key, CASE WHEN q IS NULL THEN 'not annotated' WHEN p IS NULL THEN 'not selected' WHEN p <> q THEN 'order' WHEN category <> 'lexical' THEN 'category' WHEN trim(evidence) = '' THEN 'evidence' END AS rule FROM j)
SELECT rule, key FROM r WHERE rule IS NOT NULL""")
def annotation_audit(spark, d):
    """Notes on the nations of which two swap places, one is lost, one is foreign, one has an unknown category, one no evidence."""
    n, key = table(spark, d, "nation"), F.col("n_nationkey")
    selection = n.select(key.alias("key"), (key + 1).alias("position"))
    place = F.when(key.isin(3, 4), 8 - key).otherwise(key + 1)
    notes = n.filter(key != 11).select(key.alias("key"), place.alias("position"), F.when(key == 7, "odd").otherwise("lexical").alias("category"), F.when(key == 9, " ").otherwise(F.col("n_name")).alias("evidence"))
    foreign = spark.createDataFrame([(99, 99, "lexical", "x")], notes.schema)
    return manifest.annotate(selection, notes.unionByName(foreign), "key", ("lexical",))[1]


@query(f"SELECT sha256('{__import__('json').dumps(persist.TOKENIZER, sort_keys=True, separators=(',', ':')).replace(chr(39), chr(39) * 2)}') AS fingerprint")
def tokenizer_fingerprint(spark, d):
    return spark.range(1).select(F.lit(persist.tokenizer_fingerprint()).alias("fingerprint"))


@query("""SELECT b.item_id, d.doc_id AS position, 'C' || d.doc_id AS doc, md5('C' || d.doc_id || CASE WHEN d.doc_id % 9 = 0 OR d.text IS NULL THEN '' ELSE chr(10) || d.text END) AS document_md5, d.doc_id % 9 = 0 OR d.text IS NULL AS source_missing
FROM benchmark b JOIN documents d ON d.doc_id % 10 = b.item_id % 10""")
def lexical_inputs(spark, d):
    """Each item's classes, a tenth of the documents, in order; one in nine has no source."""
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("C"), "doc_id")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("query"))
    inventory = docs.select(name.alias("doc"), F.col("doc_id").alias("position"), (F.col("doc_id") % 10).alias("tenth")).join(queries.select("item", (F.col("item") % 10).alias("tenth")), "tenth").select("item", "position", "doc")
    texts = docs.filter("doc_id % 9 <> 0 and text is not null").select(name.alias("doc"), "text")
    out = persist.lexical_inputs(queries, inventory, texts)
    return out.select(F.col("item").alias("item_id"), "position", "doc", F.md5("document").alias("document_md5"), "source_missing")


COMMIT, RUN = "c0ffee", "run-1"
ENTRY = {"provider": "house", "model_id": "overlap", "prompt_version": "p1", "price_basis": "none"}


def semantic_cache(spark, d, head: DataFrame) -> DataFrame:
    """A cache entry for every scored pair (item, doc, ext_score)."""
    fixed = {k: F.lit(v) for k, v in ENTRY.items()}
    return head.select(cache_key().alias("cache_key"), F.col("ext_score").alias("score"), *[v.alias(k) for k, v in fixed.items()], F.concat(F.lit("overlap-"), (F.col("item") % 2).cast("string")).alias("observed_model_id"),
                       F.concat(F.lit('{"input_tokens":'), "doc", F.lit("}")).alias("usage"), (F.col("doc") % 100).cast("double").alias("latency_ms"), F.concat(F.lit("r"), "doc").alias("provider_request_id"))


def cache_key() -> F.Column:
    return F.sha2(F.concat_ws("|", F.col("item").cast("string"), F.col("doc").cast("string")), 256)


def predicted(spark, d) -> tuple[DataFrame, DataFrame]:
    """(prediction rows of BM25 and of its reranking, the cache)."""
    base = R.cut(R.full_ranking(spark, d)).withColumnRenamed("rank", "base_rank")
    head = R.external_scores(base.filter(F.col("base_rank") <= R.RERANK_K))
    common = {"qualified": F.concat(F.lit("Cli-"), "item"), "slug": F.concat(F.lit("Cli_"), "item"), "commit": COMMIT, "run_id": RUN}
    name = F.concat(F.lit("C"), F.col("doc").cast("string")).alias("test_class")
    lexical = base.select("item", name, F.col("base_rank").alias("rank"), "score", F.col("base_rank").alias("bm25_rank"), F.lit(False).alias("source_missing"))
    rows = predictions.prediction_rows(lexical, None, method="BM25", path=F.concat(F.lit("rankings/"), "item"), **common)
    again = ranking.rerank(base.drop("score"), head, ["item"], "doc", R.RERANK_K)
    again = again.select("item", name, "rank", F.col("ext_score").alias("score"), F.col("base_rank").alias("bm25_rank"), F.lit(False).alias("source_missing"), "scored", F.when(F.col("scored"), cache_key()).alias("cache_key"))
    cache = semantic_cache(spark, d, head)
    return rows.unionByName(predictions.prediction_rows(again, cache, method="Rerank", path=F.concat(F.lit("semantic/"), "item"), scored=F.col("scored"), **common)), cache


NULLS = ", ".join(f"CAST(NULL AS {'DOUBLE' if c == 'latency_ms' else 'VARCHAR'}) AS {c}" for c in predictions.USAGE)
FIXED = f"'{predictions.SCHEMA_VERSION}' AS schema_version, 'Cli-' || item_id AS qualified_id, 'Cli_' || item_id AS example_id, 'evaluation' AS split"
PREDICTED = f"""{R.FULL}, rr AS (SELECT *, CASE WHEN rank <= {R.RERANK_K} THEN {R.EXT} END AS ext, row_number() OVER (PARTITION BY item_id ORDER BY rank > {R.RERANK_K}, CASE WHEN rank <= {R.RERANK_K} THEN {R.EXT} END DESC NULLS LAST, rank) AS again FROM ranked),
pr AS (SELECT {FIXED}, 'BM25' AS method, 'C' || doc_id AS test_class, CAST(rank AS INTEGER) AS rank, score, true AS score_applicable, CAST(rank AS INTEGER) AS bm25_rank, false AS source_missing, '{COMMIT}' AS experiment_commit, '{RUN}' AS run_id, 'rankings/' || item_id AS ranking_path, {NULLS}, CAST(NULL AS BOOLEAN) AS shortlist_member, CAST(NULL AS VARCHAR) AS inapplicable_reason FROM ranked
UNION ALL SELECT {FIXED}, 'Rerank', 'C' || doc_id, CAST(again AS INTEGER), ext, ext IS NOT NULL, CAST(rank AS INTEGER), false, '{COMMIT}', '{RUN}', 'semantic/' || item_id,
CASE WHEN ext IS NOT NULL THEN sha256(item_id || '|' || doc_id) END, CASE WHEN ext IS NOT NULL THEN 'house' END, CASE WHEN ext IS NOT NULL THEN 'overlap' END, CASE WHEN ext IS NOT NULL THEN 'overlap-' || (item_id % 2) END, CASE WHEN ext IS NOT NULL THEN 'p1' END,
CASE WHEN ext IS NOT NULL THEN '{{"input_tokens":' || doc_id || '}}' END, CASE WHEN ext IS NOT NULL THEN (doc_id % 100)::DOUBLE END, CASE WHEN ext IS NOT NULL THEN 'none' END, CASE WHEN ext IS NOT NULL THEN 'r' || doc_id END, ext IS NOT NULL, CASE WHEN ext IS NULL THEN '{predictions.OUTSIDE}' END FROM rr)"""


@query(f"WITH {PREDICTED} SELECT * REPLACE (round(score, 9) AS score) FROM pr")
def prediction_rows(spark, d):
    return predicted(spark, d)[0].withColumn("score", F.round("score", 9))


@query(f"""WITH {PREDICTED}, s AS (SELECT *, CAST(substr(test_class, 2) AS BIGINT) AS doc, CAST(substr(qualified_id, 5) AS BIGINT) AS item FROM pr)
SELECT 'duplicate key' AS rule, method, qualified_id, test_class FROM s WHERE method = 'BM25' AND rank = 4 UNION ALL SELECT 'missing class', method, qualified_id, test_class FROM s WHERE method = 'BM25' AND rank = 3
UNION ALL SELECT 'score differs from the cache', method, qualified_id, test_class FROM s WHERE method = 'Rerank' AND rank = 2 UNION ALL SELECT 'score outside the shortlist', method, qualified_id, test_class FROM s WHERE method = 'Rerank' AND rank = {R.RERANK_K + 1}
UNION ALL SELECT 'several observed models', method, qualified_id, NULL FROM s WHERE method = 'Rerank' AND rank = 1""")
def prediction_audit(spark, d):
    """Prediction rows of which rank 3 is lost and rank 4 comes twice in BM25; in the reranking rank 2 has another score, rank 1 another model, and the first tail row a score."""
    good, cache = predicted(spark, d)
    bm25, again = good.filter("method = 'BM25' and rank <> 3"), good.filter("method = 'Rerank'")
    score = F.when(F.col("rank") == 2, F.col("score") + 0.5).when(F.col("rank") == R.RERANK_K + 1, 0.5).otherwise(F.col("score"))
    again = again.withColumns({"score": score, "observed_model_id": F.when(F.col("rank") == 1, "another").otherwise(F.col("observed_model_id"))})
    items, docs = R.items(spark, d), R.inventory(spark, d)
    once = items.exceptAll(items.distinct()).isEmpty() and docs.groupBy("doc").count().filter("count > 1").isEmpty()
    inventory = docs.crossJoin(F.broadcast(items.distinct())).select(F.concat(F.lit("Cli-"), "item").alias("qualified_id"), F.concat(F.lit("C"), F.col("doc").cast("string")).alias("test_class"))
    return predictions.prediction_violations(bm25.unionByName(bm25.filter("rank = 4")).unionByName(again), inventory, cache, listed_once=once)


STORED = """st AS (SELECT conv_id AS item, md5(CAST(conv_id AS VARCHAR)) AS signature, turn + 1 AS rank, CASE WHEN conv_id % 11 = 3 AND turn = 0 THEN CAST('nan' AS DOUBLE) ELSE turn / 10.0::DOUBLE END AS score, count(*) OVER (PARTITION BY conv_id) AS n, turn FROM conversations),
kept AS (SELECT * FROM st WHERE NOT (item % 5 = 0 AND rank = 1)), want AS (SELECT DISTINCT conv_id AS item, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE md5(CAST(conv_id AS VARCHAR)) END AS signature FROM conversations)"""


@query(f"""WITH {STORED}, ok AS (SELECT item, signature FROM kept GROUP BY 1, 2 HAVING count(*) = count(DISTINCT rank) AND min(rank) = 1 AND max(rank) = count(*) AND max(n) = count(*) AND count(*) FILTER (score IS NULL OR isnan(score)) = 0)
SELECT w.item, w.signature, ok.item IS NOT NULL AS reused FROM want w LEFT JOIN ok USING (item, signature)""")
def ranking_cache_plan(spark, d):
    """Conversations as stored rankings: one in five has lost a rank, some a score, one in three was made from other inputs."""
    c = table(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    bad = (F.col("conv_id") % 11 == 3) & (F.col("turn") == 0)
    own = F.md5(F.col("conv_id").cast("string"))
    stored = c.join(n, "conv_id").select(F.col("conv_id").alias("item"), own.alias("signature"), (F.col("turn") + 1).alias("rank"), F.when(bad, float("nan")).otherwise(F.col("turn") / 10).alias("score"), "n").filter("not (item % 5 = 0 and rank = 1)")
    wanted = c.select(F.col("conv_id").alias("item"), F.when(F.col("conv_id") % 3 == 0, "new").otherwise(own).alias("signature")).distinct()
    todo, hit = persist.cache_plan(wanted, stored)
    return todo.withColumn("reused", F.lit(False)).unionByName(hit.select("item", "signature").distinct().withColumn("reused", F.lit(True)))


@query("""WITH b AS (SELECT c_custkey AS item, md5(c_name) AS sha, c_mktsegment AS signature FROM customer), o AS (SELECT item, CASE WHEN item % 4 = 0 THEN 'old' ELSE sha END AS sha, CASE WHEN item % 6 = 0 THEN 'old' ELSE signature END AS signature FROM b WHERE item % 5 <> 0)
SELECT b.item, CASE WHEN o.sha = b.sha AND o.signature = b.signature THEN 'reused' WHEN b.item % 8 = 0 THEN 'locked' WHEN o.item IS NOT NULL THEN 'regenerated' ELSE 'written' END AS outcome FROM b LEFT JOIN o USING (item)""")
def shortlist_persistence(spark, d):
    """Shortlists of which some are stored, some differ from what is stored, and every eighth is locked."""
    built = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.md5("c_name").alias("sha256"), F.col("c_mktsegment").alias("signature"))
    stale = lambda c, k: F.when(F.col("item") % k == 0, "old").otherwise(F.col(c)).alias(c)
    stored = built.filter("item % 5 <> 0").select("item", stale("sha256", 4), stale("signature", 6))
    return persist.persistence_plan(built, stored, built.filter("item % 8 = 0").select("item"))


SEALED = """inv AS (SELECT conv_id AS item, turn AS position, role || turn AS id FROM conversations), rk AS (SELECT m AS method, item, position + 1 AS rank, id FROM inv, (VALUES ('BM25'), ('Rerank')) t(m)),
dmg AS (SELECT * FROM rk WHERE NOT (method = 'Rerank' AND item % 9 = 0) AND NOT (method = 'BM25' AND item % 10 = 1 AND rank = 2)), n AS (SELECT item, count(*) AS n FROM inv GROUP BY 1),
sp AS (SELECT method, item, count(*) AS c, min(rank) AS lo, max(rank) AS hi FROM dmg GROUP BY 1, 2)"""


@query(f"""WITH {SEALED} SELECT 'inventory differs from the listing' AS rule, item, NULL AS method, id FROM inv WHERE item % 13 = 5 AND position = 1
UNION ALL SELECT 'no positives', item, NULL, NULL FROM n WHERE item % 12 = 7 UNION ALL SELECT 'unknown positive', item, NULL, 'nobody' FROM n WHERE item % 15 = 2
UNION ALL SELECT 'no ranking', item, 'Rerank', NULL FROM n WHERE item % 9 = 0 AND item % 2 = 1 AND item % 14 <> 3
UNION ALL SELECT 'no permutation', item, method, NULL FROM sp JOIN n USING (item) WHERE c <> n OR lo <> 1 OR hi <> n
UNION ALL SELECT 'no prefix of BM25', item, NULL, id FROM inv WHERE item % 10 = 1 AND position = 1
UNION ALL SELECT 'ranking of an accepted gap', item, 'Rerank', NULL FROM n WHERE item % 14 = 3 AND item % 9 <> 0""")
def sealed_input_audit(spark, d):
    """Conversations as bugs with an inventory of turns; listings, positives, rankings and gaps are damaged in stated places."""
    inv = table(spark, d, "conversations").select(F.col("conv_id").alias("item"), F.col("turn").alias("position"), F.concat("role", "turn").alias("id"))
    listing = inv.filter("not (item % 13 = 5 and position = 1)")
    items = inv.select("item").distinct()
    positives = inv.filter("position = 0 and item % 12 <> 7").select("item", "id").unionByName(items.filter("item % 15 = 2").select("item", F.lit("nobody").alias("id")))
    ranked = inv.select("item", (F.col("position") + 1).alias("rank"), "id").crossJoin(F.broadcast(spark.createDataFrame([("BM25",), ("Rerank",)], "method string")))
    ranked = ranked.filter("not (method = 'Rerank' and item % 9 = 0) and not (method = 'BM25' and item % 10 = 1 and rank = 2)")
    candidates = inv.filter("position < 3").select("item", (F.col("position") + 1).alias("rank"), "id")
    gaps = items.filter("item % 9 = 0 and item % 2 = 0 or item % 14 = 3").select(F.lit("Rerank").alias("method"), "item")
    # unknown positives add to those of an item without any, so such items have some
    return seal.sealed_input_violations(inv, listing, positives, candidates, ranked, gaps).filter("not (rule = 'no positives' and item % 15 = 2)")


@query("""WITH l AS (SELECT event_type || ':' || CAST(json_extract(props, '$.k') AS BIGINT) AS cache_key, event_type AS kind FROM events), p AS (SELECT DISTINCT cache_key FROM l WHERE kind <> 'view'), c AS (SELECT cache_key, count(*) AS n FROM l WHERE kind <> 'error' GROUP BY 1),
r AS (SELECT coalesce(p.cache_key, c.cache_key) AS cache_key, CASE WHEN n IS NULL THEN 'no ledger row' WHEN p.cache_key IS NULL THEN 'no pair' WHEN n > 1 THEN 'several ledger rows' END AS rule FROM p FULL JOIN c ON p.cache_key = c.cache_key) SELECT rule, cache_key FROM r WHERE rule IS NOT NULL""")
def raw_seal_audit(spark, d):
    """Pairs are the keys of all events but views, the ledger all events but errors."""
    from .ledger import events

    e = events(spark, d)
    return seal.seal_violations(e.filter("kind <> 'view'").select("cache_key"), e.filter("kind <> 'error'").select("cache_key"))


@query("""WITH a AS (SELECT page_id AS path, md5(url) AS x FROM pages WHERE page_id % 11 <> 0), b AS (SELECT page_id AS path, CASE WHEN page_id % 13 = 0 THEN 'changed' ELSE md5(url) END AS y FROM pages WHERE page_id % 7 <> 0)
SELECT CASE WHEN y IS NULL THEN 'lost' ELSE 'changed' END AS rule, path FROM a LEFT JOIN b USING (path) WHERE y IS NULL OR x <> y""")
def seal_hash_audit(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.md5("url").alias("sha256"))
    seen = p.filter("path % 7 <> 0").withColumn("sha256", F.when(F.col("path") % 13 == 0, "changed").otherwise(F.col("sha256")))
    return seal.hash_violations(p.filter("path % 11 <> 0"), seen)


CROSS = """m AS (SELECT c_mktsegment AS method, c_custkey AS item, (c_custkey % 17 + 1)::DOUBLE AS first_rank, c_custkey % 17 < 2 AS detected, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0.5::DOUBLE END AS usd FROM customer WHERE c_custkey % 41 <> 0),
s AS (SELECT method, avg(detected::INTEGER) AS rate, count(*) AS n, sum(coalesce(usd, 0)) AS usd FROM m GROUP BY 1)"""


@query(f"""WITH {CROSS} SELECT 'rank' AS rule, c_mktsegment AS method, c_custkey AS item FROM customer WHERE c_custkey % 41 = 0 OR c_custkey % 50 = 7
UNION ALL SELECT 'rate', method, NULL FROM s WHERE method = 'BUILDING' UNION ALL SELECT 'cost', method, NULL FROM s WHERE method = 'MACHINERY'""")
def consistency_audit(spark, d):
    """A metrics table that lost every 41st bug and a few ranks, and a summary with one wrong rate and one wrong cost."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("method"), F.col("c_custkey").alias("item"), (F.col("c_custkey") % 17 + 1).cast("double").alias("first_rank"))
    m = c.filter("item % 41 <> 0").withColumns({"detected": F.col("item") % 17 < 2, "usd": F.when(F.col("item") % 3 != 0, 0.5)})
    again = c.withColumn("first_rank", F.when(F.col("item") % 50 == 7, F.col("first_rank") + 1).otherwise(F.col("first_rank")))
    s = m.groupBy("method").agg(F.avg(F.col("detected").cast("int")).alias("fdr"), (F.sum(F.coalesce("usd", F.lit(0.0))) / F.count(F.lit(1))).alias("usd_per_item"))
    s = s.withColumns({"fdr": F.when(F.col("method") == "BUILDING", F.col("fdr") + 0.01).otherwise(F.col("fdr")), "usd_per_item": F.when(F.col("method") == "MACHINERY", F.col("usd_per_item") + 0.01).otherwise(F.col("usd_per_item"))})
    return seal.consistency_violations(m, again, s).select("rule", "method", F.col("item").cast("long").alias("item"))


def costs(spark, d) -> DataFrame:
    """(qualified_id, method, input_tokens, output_tokens, usd, wall_ms): what reranking an item would have cost; every tenth item has no record."""
    b = table(spark, d, "benchmark").filter("item_id % 10 <> 9")
    size = F.length("text").cast("long")
    return b.select(F.concat(F.lit("Cli-"), "item_id").alias("qualified_id"), F.lit("Random").alias("method"), size.alias("input_tokens"), (size % 7).alias("output_tokens"), F.round(size / 1000, 6).alias("usd"), (size % 500).cast("double").alias("wall_ms"))


WIDE_SQL = f"""{E.FIRST2}, ps AS (SELECT item_id, count(*) AS positives FROM pos GROUP BY 1), c AS (SELECT item_id, length(text) AS size FROM benchmark WHERE item_id % 10 <> 9),
w AS (SELECT 'Cli' AS project, CAST(m.item_id AS VARCHAR) AS bug_id, 'evaluation' AS split, method, n AS num_test_classes, coalesce(positives, 0) AS num_trigger_classes, m.first_rank AS first_trigger_rank, round(rr, 9) AS reciprocal_rank, round(nftr, 9) AS normalized_first_trigger_rank, round(apfd, 9) AS apfd,
{', '.join(f"m.first_rank <= greatest(1, CAST(ceil({b}::DOUBLE * n) AS BIGINT)) AS detected_at_{round(100 * b)}pct" for b in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0))}, m.first_rank <= {R.SHORT} AS candidate_trigger_in_top200,
CASE WHEN method = 'Random' THEN size END AS reranker_input_tokens, CASE WHEN method = 'Random' THEN size % 7 END AS reranker_output_tokens, CASE WHEN method = 'Random' THEN round(size / 1000.0::DOUBLE, 6) ELSE 0.0 END AS reranker_cost_usd, CASE WHEN method = 'Random' THEN (size % 500)::DOUBLE END AS reranker_wall_ms,
false AS patch_truncated, 0 AS missing_test_source_count, m.first_rank IS NOT NULL AS available, '{COMMIT}' AS experiment_commit, '{RUN}' AS run_id, 'Cli-' || m.item_id AS qualified_id FROM (SELECT x.method, b.item_id, m.first_rank, st.n, m.rr, m.nftr, m.apfd FROM benchmark b CROSS JOIN (VALUES ('BM25'), ('Random')) x(method) CROSS JOIN st LEFT JOIN m ON m.item_id = b.item_id AND m.method = x.method) m LEFT JOIN ps USING (item_id) LEFT JOIN c USING (item_id))"""


def wide(spark, d) -> DataFrame:
    judged = docs, pos, _ = R.judged(spark, d)
    ranks = E.first_ranks(spark, d, judged).select("method", "item", "first_rank")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    every = R.items(spark, d).crossJoin(F.broadcast(spark.createDataFrame([("BM25",), ("Random",)], "method string"))).crossJoin(F.broadcast(n))  # methods are two, n is one row
    m = every.join(ranks, ["method", "item"], "left").join(pos.groupBy("item").agg(F.count(F.lit(1)).alias("positives")), "item", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))
    m = m.select(F.concat(F.lit("Cli-"), "item").alias("qualified_id"), "method", "first_rank", "n", "positives", (F.col("first_rank") <= R.SHORT).alias("in_shortlist"), F.lit(False).alias("patch_truncated"), F.lit(0).alias("source_missing"))
    return metrics.wide_metrics(m, costs(spark, d), ("BM25",), COMMIT, RUN)


@query(f"WITH {WIDE_SQL} SELECT * FROM w")
def metrics_table(spark, d):
    """All 28 columns, with the hash order as if it were a paid method; items without a positive document have no ranking to judge."""
    return wide(spark, d)


RATES = ", ".join(f"round(avg(CAST(first_rank <= greatest(1, CAST(ceil({b}::DOUBLE * n) AS BIGINT)) AS DOUBLE)), 6) AS fdr_{round(100 * b)}" for b in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0))


@query(f"""WITH {E.FIRST2}, c AS (SELECT 'Random' AS method, sum(round(length(text) / 1000.0::DOUBLE, 6)) AS usd, round(avg(length(text) % 500), 6) AS mean_ms, round(quantile_cont(length(text) % 500, 0.5), 6) AS p50_ms, round(quantile_cont(length(text) % 500, 0.95), 6) AS p95_ms FROM benchmark WHERE item_id % 10 <> 9),
g AS (SELECT method, count(*) AS denominator, {RATES}, round(avg(rr), 6) AS mrr, round(avg(apfd), 6) AS mean_apfd, round(avg(nftr), 6) AS mean_nftr, round(quantile_cont(nftr, 0.5), 6) AS median_nftr FROM m GROUP BY 1)
SELECT g.*, round(usd / denominator, 6) AS usd_per_item, mean_ms, p50_ms, p95_ms FROM g LEFT JOIN c USING (method)""")
def cohort_summary(spark, d):
    c = costs(spark, d)
    spent = c.groupBy("method").agg(F.sum("usd").alias("usd"))
    late = c.groupBy("method").agg(F.round(F.avg("wall_ms"), 6).alias("mean_ms"), F.round(F.percentile("wall_ms", 0.5), 6).alias("p50_ms"), F.round(F.percentile("wall_ms", 0.95), 6).alias("p95_ms"))
    return metrics.cohort_summary(E.item_metrics(spark, d), ["method"], spent, late)


@query(f"WITH {E.FIRST2} SELECT project, method, count(*) AS denominator, round(avg(CAST(first_rank <= greatest(1, CAST(ceil(0.1::DOUBLE * n) AS BIGINT)) AS DOUBLE)), 6) AS fdr_10 FROM m GROUP BY 1, 2")
def figure_project_fdr(spark, d):
    return metrics.cohort_summary(E.item_metrics(spark, d), ["project", "method"]).select("project", "method", "denominator", "fdr_10")


@query(f"""WITH {E.FIRST2}, c AS (SELECT 'Random' AS method, sum(round(length(text) / 1000.0::DOUBLE, 6)) AS usd FROM benchmark WHERE item_id % 10 <> 9),
g AS (SELECT method, round(avg(CAST(first_rank <= greatest(1, CAST(ceil(0.1::DOUBLE * n) AS BIGINT)) AS DOUBLE)), 6) AS fdr_10, count(*) AS denominator FROM m GROUP BY 1), qc AS (SELECT method, fdr_10, round(usd / denominator, 6) AS usd_per_item FROM g JOIN c USING (method))
SELECT method, 'fdr_10' AS axis, fdr_10 AS value FROM qc UNION ALL SELECT method, 'usd_per_item', usd_per_item FROM qc""")
def figure_quality_cost(spark, d):
    """The paid method's point, a row an axis."""
    spent = costs(spark, d).groupBy("method").agg(F.sum("usd").alias("usd"))
    s = metrics.cohort_summary(E.item_metrics(spark, d), ["method"], spent).filter("usd_per_item is not null").select("method", "fdr_10", "usd_per_item")
    return s.unpivot(["method"], ["fdr_10", "usd_per_item"], "axis", "value")


ENTRIES = """e AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 'v0' ELSE 'v1' END AS schema_version, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value / 100 AS score, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


@query(f"""WITH {ENTRIES} SELECT 'schema version' AS rule, event_id FROM e WHERE schema_version <> 'v1' UNION ALL SELECT 'status', event_id FROM e WHERE status <> 'ok' UNION ALL SELECT 'score', event_id FROM e WHERE NOT coalesce(score BETWEEN 0 AND 1, false)
UNION ALL SELECT 'tokens', event_id FROM e WHERE k - 10 < 0 UNION ALL SELECT 'cached tokens', event_id FROM e WHERE coalesce(k, 0) > 60 UNION ALL SELECT 'key', event_id FROM e WHERE event_id % 97 = 5""")
def score_entry_audit(spark, d):
    """Events as cached scores, judged by the rules of an entry."""
    from ..sources.tables import json_field

    k = json_field(F.col("props"), "k", "long")
    key = F.md5(F.col("event_id").cast("string"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 101 == 0, "v0").otherwise("v1").alias("schema_version"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), (F.col("value") / 100).alias("score"), F.lit(60).cast("long").alias("input_tokens"), k.alias("cached_tokens"), (k - 10).alias("output_tokens"), key.alias("cache_key"), F.when(F.col("event_id") % 97 == 5, "other").otherwise(key).alias("recomputed"))
    return audit.violations(e, audit.score_entry_rules("v1"), ["event_id"])


@query("""SELECT 'dimension' AS rule, vec_id FROM embeddings WHERE vec_id % 30 = 4 UNION ALL SELECT 'not zero', vec_id FROM embeddings WHERE vec_id % 30 = 5 UNION ALL SELECT 'finite', vec_id FROM embeddings WHERE vec_id % 30 = 6""")
def embedding_entry_audit(spark, d):
    """Vectors of which some are short, zero or infinite."""
    v, i = F.col("embedding"), F.col("vec_id") % 30
    damaged = F.when(i == 4, F.slice(v, 1, 3)).when(i == 5, F.transform(v, lambda x: x * 0)).when(i == 6, F.transform(v, lambda _: F.lit(float("inf")).cast("float"))).otherwise(v)
    e = table(spark, d, "embeddings").select("vec_id", F.lit("v1").alias("schema_version"), damaged.alias("embedding"))
    return audit.violations(e, audit.embedding_entry_rules("v1", 64), ["vec_id"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '—' ELSE printf('%.6f', c_acctbal / 1000) END AS usd, CASE WHEN c_custkey % 5 = 0 THEN '—' ELSE printf('%.1f', c_acctbal / 10000 * 100) || '%' END AS percent, c_mktsegment || '_' || c_custkey AS slug, lower(replace(replace(replace('GPT-Nano v' || c_custkey || '.x', ' ', '_'), '.', '_'), '-', '_')) AS method, round((c_acctbal / 10000 - 0.5) * 100, 6) AS points FROM customer")
def formats(spark, d):
    """Money, shares, slugs and percentage points of every customer."""
    from ..functions import scoring as S

    x = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("double"))
    return table(spark, d, "customer").select("c_custkey", T.format_usd(x / 1000).alias("usd"), T.format_percent(x / 10000).alias("percent"), T.id_slug(F.col("c_mktsegment"), F.col("c_custkey")).alias("slug"), T.method_slug(F.concat(F.lit("GPT-Nano v"), "c_custkey", F.lit(".x"))).alias("method"), F.round(S.percentage_points(F.col("c_acctbal").cast("double") / 10000 - 0.5), 6).alias("points"))


@query("SELECT o_orderkey, round(ceil((o_orderkey % 9 + 1) * 200 * (o_custkey % 50 + 0.5::DOUBLE)) * 0.042::DOUBLE / 1e6 * (1 + 0.055::DOUBLE), 9) AS usd FROM orders")
def workload_cost(spark, d):
    """What ranking 200 candidates of some bugs would cost, by tokens a call."""
    from ..functions import scoring as S

    bugs, tokens = F.col("o_orderkey") % 9 + 1, F.col("o_custkey") % 50 + 0.5
    return table(spark, d, "orders").select("o_orderkey", F.round(S.workload_usd(bugs, F.lit(200), tokens, F.lit(0.042), F.lit(0.055)), 9).alias("usd"))
