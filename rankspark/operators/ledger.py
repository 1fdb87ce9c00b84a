"""Usage-ledger analytics: dedupe, shared cost, latency, waves, rate and spend gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import order, quantiles


def first_per_key(ledger: DataFrame, key: str, seq: str) -> DataFrame:
    """The earliest row of each key. An aggregate, so each task keeps one row a key before the shuffle."""
    rest = [c for c in ledger.columns if c not in (key, seq)]
    first = ledger.groupBy(key).agg(F.min_by(F.struct(seq, *rest), F.col(seq)).alias("r"))
    return first.select(key, "r.*")


def totals_by_kind(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 4).alias("usd"), F.count("usd").alias("priced"))


def equal_share(use: DataFrame, cost: DataFrame, key: str, bug: str) -> DataFrame:
    """Each key's cost over the distinct bugs that use it, summed by bug."""
    pairs = use.select(key, bug).distinct()
    share = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(cost, key).select(key, (F.col("cost") / F.col("n")).alias("share"))
    return pairs.join(share, key).groupBy(bug).agg(F.round(F.sum("share"), 4).alias("usd"), F.count(F.lit(1)).alias("n_keys"))


def share_violations(use: DataFrame, cost: DataFrame, shares: DataFrame, key: str, bug: str, tolerance: float = 1e-6) -> DataFrame:
    """(rule, key): keys in use without a cost, costs of no use, and a total of shares that misses the total of costs."""
    used = use.select(key).distinct().withColumn("used", F.lit(True))
    j = used.join(cost.select(key, "cost"), key, "full_outer")
    rule = F.when(F.col("cost").isNull(), "no cost").when(F.col("used").isNull(), "no use")
    bad = j.select(rule.alias("rule"), key).filter("rule is not null")
    paid = j.filter("used").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("paid")).crossJoin(shares.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("shared")))  # one row each
    off = paid.filter(F.abs(F.col("paid") - F.col("shared")) > tolerance).select(F.lit("total").alias("rule"), F.lit(None).cast("string").alias(key))
    return bad.unionByName(off)


def latency_summary(ledger: DataFrame, by: list[str], latency: str) -> DataFrame:
    """(by, n, mean_ms, p50_ms, p95_ms); a group without a latency has null but for n."""
    x = F.col(latency).cast("double")
    mean = ledger.groupBy(*by).agg(F.count(latency).alias("n"), F.round(F.avg(x), 6).alias("mean_ms")).withColumn("_g", F.struct(*by) if by else F.lit(0))
    p = quantiles.percentiles(ledger, by, latency, [0.5, 0.95]).withColumn("_g", F.struct(*by) if by else F.lit(0))
    at = lambda share: F.round(F.max(F.when(F.col("share") == share, F.col("value"))), 6)
    wide = p.groupBy("_g").agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))
    return mean.join(wide, "_g", "left").drop("_g")


def wave_wall(ledger: DataFrame, bug: str, order: str, latency: str, concurrency: int) -> DataFrame:
    """Wall time if calls of a bug run in waves of `concurrency`, in order: sum of each wave's maximum."""
    at = F.row_number().over(Window.partitionBy(bug).orderBy(order)) - 1
    waves = ledger.withColumn("wave", F.floor(at / concurrency)).groupBy(bug, "wave").agg(F.max(latency).alias("wall"))
    return waves.groupBy(bug).agg(F.round(F.sum("wall"), 4).alias("wall_ms"), F.count(F.lit(1)).alias("n_waves"))


def rolling_count(ledger: DataFrame, by: list[str], ts: str, seconds: int) -> DataFrame:
    """Calls that began in the `seconds` up to each call, itself included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy("micros").rangeBetween(-seconds * 1_000_000, 0)
    return ledger.withColumn("micros", micros).withColumn("in_window", F.count(F.lit(1)).over(w)).drop("micros")


RUN = 4_096  # calls of one chain that one window reads


def rate_gate(ledger: DataFrame, by: list[str], ts: str, seq: str, limit: int, seconds: int, run: int = RUN) -> DataFrame:
    """Adds started and waited (microseconds): when each call may start, if no more than `limit` start within `seconds`, first come first served.

    start(i) = max(arrival(i), start(i - limit) + seconds), so calls i, i + limit, i + 2 limit, ... of a key are a chain, and along
    a chain start is the running maximum of arrival - place x seconds, plus place x seconds. Maxima add up: a chain is cut into
    runs, each run's maximum is a row, a running maximum over these rows is what each run starts with. So a key with most calls
    is limit x runs tasks' work, not one's.
    """
    step = seconds * 1_000_000
    at = order.ranked(ledger.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))), by, "_us", seq, name="_i")
    place = F.floor((F.col("_i") - 1) / limit)
    at = at.withColumns({"_chain": (F.col("_i") - 1) % limit, "_place": place, "_run": F.floor(place / run)}).withColumn("_lead", F.col("_us") - F.col("_place") * step)
    key = [*by, "_chain", "_run"]
    at = at.withColumn("_k", F.struct(*key))
    before = F.max("_top").over(Window.partitionBy(*by, "_chain").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    tops = at.groupBy(*key).agg(F.max("_lead").alias("_top")).select(F.struct(*key).alias("_k"), before.alias("_before"))
    own = F.max("_lead").over(Window.partitionBy("_k").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = at.withColumn("_own", own).join(tops, "_k")
    start = F.greatest("_own", "_before") + F.col("_place") * step  # greatest() passes over a null
    out = out.withColumn("started", F.timestamp_micros(start)).withColumn("waited", start - F.col("_us"))
    return out.drop("_us", "_i", "_chain", "_place", "_run", "_lead", "_k", "_own", "_before")


def running_spend(ledger: DataFrame, by: str, order: str, usd: str, ceiling: float, digits: int = 9) -> DataFrame:
    """(by, order, spent, allowed): reserved spend after each call, and whether it fitted under the ceiling; a refused call reserves nothing.

    Whether a call fits depends on all before it, so a key's calls are read in order by one task; it holds one sum, not the calls.
    Null and negative costs reserve nothing.
    """
    kinds = dict(ledger.dtypes)
    rows = ledger.select(by, order, F.greatest(F.coalesce(F.col(usd), F.lit(0.0)), F.lit(0.0)).alias("usd")).repartition(by).sortWithinPartitions(by, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, spent = object(), 0.0
        for pdf in batches:
            out = []
            for key, cost in zip(pdf[by], pdf["usd"], strict=True):
                if key != last:
                    last, spent = key, 0.0
                fits = spent + cost <= ceiling + 1e-12
                spent += cost if fits else 0.0
                out.append((round(spent, digits), fits))
            pdf["spent"], pdf["allowed"] = [x[0] for x in out], [x[1] for x in out]
            yield pdf[[by, order, "spent", "allowed"]]

    return rows.mapInPandas(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, spent double, allowed boolean")


def settled_spend(calls: DataFrame, by: str, estimate: str, actual: str) -> DataFrame:
    """(by, reserved, spent): estimates of allowed calls, and what is left once actual costs replace them; without an actual cost the reservation stays."""
    kept = F.coalesce(F.when(F.col(actual) >= 0, F.col(actual)), F.col(estimate))
    return calls.filter("allowed").groupBy(by).agg(F.round(F.sum(estimate), 6).alias("reserved"), F.round(F.sum(kept), 6).alias("spent"))


def cost_breakdown(ledger: DataFrame, tokens: Column, rate: Column, fee: Column) -> DataFrame:
    inference = S.inference_usd(tokens, rate)
    return ledger.withColumns({"inference_usd": F.round(inference, 9), "fee_usd": F.round(inference * fee, 9), "effective_usd": F.round(S.effective_usd(inference, fee), 9)})


def proportional_allocation(df: DataFrame, by: list[str], order: str, weight: str, total: str) -> DataFrame:
    """Integer shares of `total` by weight that sum exactly: floors of the running share, differenced."""
    w = Window.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    upto = F.when(F.sum(weight).over(w) > 0, F.expr(f"`{total}` * 1L") * run / F.sum(weight).over(w)).otherwise(0.0)
    cut = df.withColumn("upto", F.floor(upto).cast("long"))
    return cut.withColumn("share", F.col("upto") - F.coalesce(F.lag("upto").over(w.orderBy(order)), F.lit(0))).drop("upto")


def spend_estimate(jobs: DataFrame, cached: DataFrame, key: str, usd: str, ceiling: float) -> DataFrame:
    todo = jobs.join(cached.select(key).distinct(), key, "left_anti")
    return todo.agg(F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum(usd), F.lit(0.0)), 4).alias("usd")).withColumn("within_ceiling", F.col("usd") <= ceiling)
