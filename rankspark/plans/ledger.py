"""Ledger queries over events: kind = event_type, bug = user_id, cache key = event_type:k, latency = value, seq = event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_key
from ..functions.scoring import response_score
from ..operators import audit, ledger, order, scorer
from ..sources.scratch import cut
from ..sources.tables import cache_misses, json_field, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
L = "l AS (SELECT event_id AS seq, ts, user_id AS bug, event_type AS kind, event_type || ':' || CAST(json_extract(props, '$.k') AS BIGINT) AS cache_key, value AS latency, round(value / 100, 4) AS usd, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
RATE, FEE = 0.042, 0.055  # fixed values: USD per million tokens and platform fee


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def events(spark, d) -> DataFrame:
    k = json_field(F.col("props"), "k", "long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("bug"), F.col("event_type").alias("kind"), F.concat_ws(":", "event_type", k.cast("string")).alias("cache_key"),
        F.col("value").alias("latency"), F.round(F.col("value") / 100, 4).alias("usd"), k.alias("k"))


@query(f"WITH {L} SELECT cache_key, min(seq) AS seq, arg_min(bug, seq) AS bug, arg_min(latency, seq) AS latency FROM l GROUP BY 1")
def ledger_dedupe_first(spark, d):
    return ledger.first_per_key(events(spark, d).select("cache_key", "seq", "bug", "latency"), "cache_key", "seq")


@query(f"WITH {L} SELECT kind, count(*) AS calls, round(sum(coalesce(usd, 0)), 4) AS usd, count(usd) AS priced FROM l GROUP BY 1")
def ledger_totals_by_kind(spark, d):
    return ledger.totals_by_kind(events(spark, d))


@query(f"""WITH {L}, c AS (SELECT cache_key, arg_min(usd, seq) AS cost FROM l GROUP BY 1), p AS (SELECT DISTINCT cache_key, bug FROM l), s AS (SELECT cache_key, cost / count(*) AS share FROM p JOIN c USING (cache_key) GROUP BY cache_key, cost)
SELECT bug, round(sum(share), 4) AS usd, count(*) AS n_keys FROM p JOIN s USING (cache_key) GROUP BY 1""")
def ledger_equal_share(spark, d):
    e = events(spark, d)
    cost = e.groupBy("cache_key").agg(F.min_by("usd", "seq").alias("cost"))
    return ledger.equal_share(e, cost, "cache_key", "bug")


@query(f"""WITH {L}, c AS (SELECT cache_key, arg_min(usd, seq) AS cost FROM l WHERE k % 10 <> 3 GROUP BY 1), u AS (SELECT DISTINCT cache_key FROM l WHERE kind <> 'error')
SELECT CASE WHEN c.cache_key IS NULL THEN 'no cost' ELSE 'no use' END AS rule, coalesce(u.cache_key, c.cache_key) AS cache_key FROM u FULL JOIN c ON u.cache_key = c.cache_key WHERE c.cache_key IS NULL OR u.cache_key IS NULL UNION ALL SELECT 'total', NULL""")
def ledger_share_audit(spark, d):
    """Costs are lost for one key in ten, calls that failed use nothing, and the shares were made from halved costs."""
    e = events(spark, d)
    cost = e.filter("k % 10 <> 3").groupBy("cache_key").agg(F.min_by("usd", "seq").alias("cost"))
    use = e.filter("kind <> 'error'")
    shares = ledger.equal_share(use, cost.withColumn("cost", F.col("cost") / 2), "cache_key", "bug")
    return ledger.share_violations(use, cost, shares, "cache_key", "bug")


@query(f"""WITH {L}, w AS (SELECT bug, (row_number() OVER (PARTITION BY bug ORDER BY seq) - 1) // 16 AS wave, latency FROM l), x AS (SELECT bug, wave, max(latency) AS wall FROM w GROUP BY 1, 2), y AS (SELECT bug, round(sum(wall), 4) AS wall_ms FROM x GROUP BY 1)
SELECT 'all' AS method, count(*) AS n, round(avg(wall_ms), 6) AS mean_ms, round(quantile_cont(wall_ms, 0.5), 6) AS p50_ms, round(quantile_cont(wall_ms, 0.95), 6) AS p95_ms FROM y""")
def ledger_wall_summary(spark, d):
    """Latency over bugs: each one's wall time as its waves add up."""
    wall = ledger.wave_wall(events(spark, d), "bug", "seq", "latency", 16).withColumn("method", F.lit("all"))
    return ledger.latency_summary(wall, ["method"], "wall_ms")


RESPONSE = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{{"answers":{{"q1":{{"noul":' || v || '}}}}}}' WHEN 1 THEN '{{"text":"{{\\"probability\\": ' || v || '}}"}}' WHEN 2 THEN '{{"text":"{{\\"probability\\": ' || v || ', \\"why\\": 1}}"}}' WHEN 3 THEN '{{"answers":{{"q2":{{"noul":0.5}}}}}}' ELSE 'no json' END AS r
FROM (SELECT event_id, CAST((event_id % 130) / 100.0 AS DECIMAL(6, 2)) AS v FROM events))""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH x AS (SELECT event_id, CASE WHEN json_valid(r) THEN try_cast(json_extract_string(r, '$.answers.q1.noul') AS DOUBLE) END AS a, CASE WHEN json_valid(r) THEN json_extract_string(r, '$.text') END AS t FROM {RESPONSE}),
y AS (SELECT event_id, coalesce(a, CASE WHEN t IS NOT NULL AND len(json_keys(t)) = 1 THEN try_cast(json_extract_string(t, '$.probability') AS DOUBLE) END) AS s FROM x) SELECT event_id, s AS score, coalesce(s BETWEEN 0 AND 1, false) AS valid FROM y""")
def score_nested_parse(spark, d):
    """Answers by question id, or a text that is JSON with the one key `probability`; anything else has no score."""
    e = F.col("event_id") % 5
    v = ((F.col("event_id") % 130) / 100).cast("decimal(6,2)").cast("string")
    wrap = lambda a, b: F.concat(F.lit(a), v, F.lit(b))
    r = F.when(e == 0, wrap('{"answers":{"q1":{"noul":', "}}}")).when(e == 1, wrap('{"text":"{\\"probability\\": ', '}"}')).when(e == 2, wrap('{"text":"{\\"probability\\": ', ', \\"why\\": 1}"}')).when(e == 3, '{"answers":{"q2":{"noul":0.5}}}').otherwise("no json")
    s = response_score(r, "q1")
    return table(spark, d, "events").select("event_id", s.alias("score")).withColumn("valid", F.coalesce(F.col("score").between(0, 1), F.lit(False)))


@query(f"WITH {L} SELECT seq, k * 1000 AS tokens, round(k * 1000 * {RATE} / 1e6, 9) AS inference_usd, round(k * 1000 * {RATE} / 1e6 * {FEE}, 9) AS fee_usd, round(k * 1000 * {RATE} / 1e6 * (1 + {FEE}), 9) AS effective_usd FROM l".replace(f"* {RATE}", f"* {RATE}::DOUBLE").replace(f"* {FEE}", f"* {FEE}::DOUBLE").replace(f"(1 + {FEE})", f"(1 + {FEE}::DOUBLE)"))
def ledger_cost_breakdown(spark, d):
    e = events(spark, d).withColumn("tokens", F.col("k") * 1000)
    return ledger.cost_breakdown(e, F.col("tokens"), F.lit(RATE), F.lit(FEE)).select("seq", "tokens", "inference_usd", "fee_usd", "effective_usd")


@query(f"WITH {L} SELECT kind, count(latency) AS n, round(avg(latency), 6) AS mean_ms, round(quantile_cont(latency, 0.5), 6) AS p50_ms, round(quantile_cont(latency, 0.95), 6) AS p95_ms FROM l GROUP BY 1")
def ledger_percentiles(spark, d):
    return ledger.latency_summary(events(spark, d), ["kind"], "latency")


@query(f"WITH {L}, w AS (SELECT bug, (row_number() OVER (PARTITION BY bug ORDER BY seq) - 1) // 16 AS wave, latency FROM l), x AS (SELECT bug, wave, max(latency) AS wall FROM w GROUP BY 1, 2) SELECT bug, round(sum(wall), 4) AS wall_ms, count(*) AS n_waves FROM x GROUP BY 1")
def ledger_wave_wall(spark, d):
    return ledger.wave_wall(events(spark, d), "bug", "seq", "latency", 16)


@query(f"WITH {L} SELECT seq, bug, count(*) OVER (PARTITION BY bug ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY bug ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS in_day FROM l")
def ledger_rolling_60s(spark, d):
    day = ledger.rolling_count(events(spark, d), ["bug"], "ts", 86_400).withColumnRenamed("in_window", "in_day")
    return ledger.rolling_count(day, ["bug"], "ts", 60).select("seq", "bug", "in_window", "in_day")


@query(f"""WITH RECURSIVE {L}, o AS MATERIALIZED (SELECT seq, kind, epoch_us(ts) AS us, row_number() OVER (PARTITION BY kind ORDER BY ts, seq) AS i FROM l),
r AS (SELECT seq, kind, i, us, us AS start FROM o WHERE i <= 3 UNION ALL SELECT o.seq, o.kind, o.i, o.us, greatest(o.us, r.start + 7200 * 1000000::BIGINT) FROM r JOIN o ON o.kind = r.kind AND o.i = r.i + 3)
SELECT seq, kind, start - us AS waited_us FROM r""")
def ledger_rate_gate(spark, d):
    """Every kind of call as a model whose route lets three calls start in two hours."""
    return ledger.rate_gate(events(spark, d).select("seq", "ts", "kind"), ["kind"], "ts", "seq", 3, 7_200).select("seq", "kind", F.col("waited").alias("waited_us"))


GATE = f"""WITH RECURSIVE {L}, o AS (SELECT *, greatest(coalesce(usd, 0), 0) AS c, row_number() OVER (PARTITION BY bug ORDER BY seq) AS i FROM l),
r AS (SELECT bug, seq, i, usd, CASE WHEN c <= 2.0::DOUBLE + 1e-12::DOUBLE THEN c ELSE 0 END AS run, c <= 2.0::DOUBLE + 1e-12::DOUBLE AS allowed FROM o WHERE i = 1
UNION ALL SELECT o.bug, o.seq, o.i, o.usd, CASE WHEN r.run + o.c <= 2.0::DOUBLE + 1e-12::DOUBLE THEN r.run + o.c ELSE r.run END, r.run + o.c <= 2.0::DOUBLE + 1e-12::DOUBLE FROM r JOIN o ON o.bug = r.bug AND o.i = r.i + 1)"""


@query(f"{GATE} SELECT seq, bug, round(run, 4) AS spent, allowed FROM r")
def ledger_running_spend(spark, d):
    return ledger.running_spend(events(spark, d), "bug", "seq", "usd", 2.0, 4).select("seq", "bug", "spent", "allowed")


@query(f"{GATE} SELECT bug, round(sum(usd), 6) AS reserved, round(sum(CASE WHEN seq % 3 = 0 THEN usd ELSE usd / 2 END), 6) AS spent FROM r WHERE allowed GROUP BY 1")
def ledger_settled_spend(spark, d):
    """Two calls in three come back at half their estimate; the third has no known cost and keeps its reservation."""
    e = events(spark, d)
    gate = ledger.running_spend(e, "bug", "seq", "usd", 2.0).select("seq", "allowed")
    calls = e.join(gate, "seq").withColumn("actual", F.when(F.col("seq") % 3 != 0, F.col("usd") / 2))
    return ledger.settled_spend(calls, "bug", "usd", "actual")


@query(f"WITH {L} SELECT DISTINCT cache_key FROM l WHERE cache_key NOT IN (SELECT cache_key FROM l WHERE kind = 'view' OR k < 50)")
def ledger_cache_miss(spark, d):
    e = events(spark, d)
    return cache_misses(e.select("cache_key"), e.filter("kind = 'view' or k < 50"))


@query(f"WITH {L} SELECT count(*) AS calls, round(coalesce(sum(usd), 0), 4) AS usd, round(coalesce(sum(usd), 0), 4) <= 16.23 AS within_ceiling FROM l WHERE cache_key NOT IN (SELECT cache_key FROM l WHERE k < 50)")
def ledger_spend_estimate(spark, d):
    e = events(spark, d)
    return ledger.spend_estimate(e, e.filter("k < 50"), "cache_key", "usd", 16.23)


@query(f"WITH {L}, a AS (SELECT DISTINCT bug FROM l WHERE kind = 'error'), b AS (SELECT DISTINCT bug FROM l WHERE kind = 'purchase') SELECT coalesce(a.bug, b.bug) AS bug, CASE WHEN a.bug IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM a FULL JOIN b ON a.bug = b.bug WHERE a.bug IS NULL OR b.bug IS NULL")
def ledger_reconcile(spark, d):
    e = events(spark, d)
    return audit.reconcile_keys(e.filter("kind = 'error'"), e.filter("kind = 'purchase'"), ["bug"])


@query(f"WITH {L} SELECT bug, count(DISTINCT cache_key) AS n_keys, count(DISTINCT kind) AS n_kinds, md5(string_agg(DISTINCT kind, ',' ORDER BY kind)) AS kinds_md5 FROM l GROUP BY 1")
def ledger_usage_sets(spark, d):
    """The distinct keys of each bug, counted, and its distinct kinds as a set: there are few kinds, whatever the rows."""
    kinds = F.array_sort(F.collect_set("kind"))
    return events(spark, d).groupBy("bug").agg(F.countDistinct("cache_key").alias("n_keys"), F.countDistinct("kind").alias("n_kinds"), F.md5(F.array_join(kinds, ",")).alias("kinds_md5"))


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS chars, 1000 AS total FROM conversations), u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run, sum(chars) OVER (PARTITION BY conv_id) AS allc FROM t),
v AS (SELECT *, CASE WHEN allc > 0 THEN CAST(floor(CAST(total * run AS DOUBLE) / CAST(allc AS DOUBLE)) AS BIGINT) ELSE 0 END AS upto FROM u) SELECT conv_id, turn, CAST(upto - coalesce(lag(upto) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS BIGINT) AS share FROM v""")
def token_allocation(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.lit(1000).cast("long").alias("total"))
    return ledger.proportional_allocation(c, ["conv_id"], "turn", "chars", "total").select("conv_id", "turn", "share")


@query(f"""WITH {L}, w AS (SELECT DISTINCT sha256('{{"kind":"' || kind || '","model_id":"m1","prompt_version":null,"state":"' || k || '"}}') AS cache_key, kind, k FROM l) SELECT cache_key, kind, k FROM w""")
def content_keys(spark, d):
    e = events(spark, d).select("kind", "k").distinct()
    key = content_key(kind=F.col("kind"), model_id=F.lit("m1"), prompt_version=F.lit(None).cast("string"), state=F.col("k").cast("string"))
    return e.select(key.alias("cache_key"), "kind", "k")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) / 1000 AS score, CAST(json_extract(props, '$.k') AS DOUBLE) / 1000 BETWEEN 0 AND 1 AND length(CAST(json_keys(props) AS VARCHAR)) = 3 + 0 * event_id AS valid FROM events".replace("length(CAST(json_keys(props) AS VARCHAR)) = 3 + 0 * event_id", "len(json_keys(props)) = 1"))
def score_json_parse(spark, d):
    """A response is valid if its JSON has the one expected key and the score lies in [0, 1]."""
    score = json_field(F.col("props"), "k", "double") / 1000
    one = F.size(F.json_object_keys("props")) == 1
    return table(spark, d, "events").select("event_id", score.alias("score"), F.coalesce(score.between(0, 1) & one, F.lit(False)).alias("valid"))


def numbered_texts(df: DataFrame, text: str) -> DataFrame:
    """df with `text`_id, the number of its text among the distinct ones; nulls are one text."""
    each = order.numbered(df.select(text).distinct(), text, name=f"{text}_id").withColumnRenamed(text, "_text")
    return cut(df.join(each, F.col(text).eqNullSafe(F.col("_text"))).drop("_text"))


@query()
def scorer_map(spark, d):
    """Every conversation's stated question scored against every benchmark passage by the stand-in model; pairs of the first five passages are in the cache."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("state"))
    q = table(spark, d, "conversations").filter("turn = 0").select("conv_id", F.col("text").alias("question"))
    b, q = numbered_texts(b, "state"), numbered_texts(q, "question")
    pairs = spread(q).crossJoin(b).withColumn("cache_key", F.unhex(F.sha2(F.concat_ws("|", "item", "question"), 256)))  # as bytes, half of its digits
    cache = pairs.filter("item < 5").select("cache_key").distinct().withColumn("score", F.lit(0.5))
    out = scorer.score_shortlist(pairs, cache, scorer.overlap_scorer, max_concurrency=4, ids=("state_id", "question_id"))
    return out.select("item", "conv_id", F.lower(F.hex("cache_key")).alias("cache_key"), "score", "status")


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS calls, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def ledger_hourly(spark, d):
    """The batch form of the streaming ledger's tumbling cost."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("value"))
