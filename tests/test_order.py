"""Places, ranks and percentiles without a window or a sorted list of a whole group, against plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators import order, quantiles


def test_places_and_ranks_of_one_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 4 else rng.choice(["a", None, "c"]), rng.choice([None, 1.5, -2.0, 7.0, rng.random()])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(7)
    at = {r.position: r for r in order.numbered(df, F.col("v").desc_nulls_last(), "i").collect()}
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert [at[k].i for k in range(len(rows))] == [r[0] for r in want]
    got = defaultdict(dict)
    for r in order.ranked(df, ["g"], F.col("v").desc_nulls_last(), "i", size="n").collect():
        got[r.g][r["rank"]] = r.i
        assert r.n == sum(x[1] == r.g for x in rows)
    assert got == {g: {k: r[0] for k, r in enumerate([r for r in want if r[1] == g], 1)} for g in ("hot", "a", None, "c")}
    assert order.numbered(df.filter("false"), "i").collect() == [] and order.ranked(df.filter("false"), ["g"], "i").collect() == []


def test_no_window_over_a_group(spark):
    df = spark.range(1_000).select("id", (F.col("id") % 2).alias("g"))
    plan = order.ranked(df, ["g"], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert all("windowspecdefinition(_range" in line for line in plan.splitlines() if "Window [" in line)


@pytest.mark.parametrize(("few", "grid"), [(1_000, 1_024), (1, 64)])
def test_percentiles_by_narrowing(spark, few, grid):
    rng = random.Random(few)
    groups = {"hot": [rng.gauss(0, 1e3) for _ in range(2_500)], "ties": [float(rng.randrange(2)) for _ in range(600)], "one": [4.25], "same": [3.0] * 300, "wild": [math.copysign(10.0 ** rng.uniform(-300, 300), rng.random() - 0.5) for _ in range(400)],
              "nan": [float(i) for i in range(40)] + [float("nan")] * 3, "two": [0.0] * 50 + [1.0] * 50, "inf": [float("-inf"), 1.0, 2.0, 3.0, 4.0], None: [1.0, 2.0, None], "empty": [None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.5, 0.95, 0.123, 1.0]
    got = {(r.g, r.share): r.value for r in quantiles.percentiles(df, ["g"], "v", shares, few, grid).collect()}
    for g, vs in groups.items():
        vs = [v for v in vs if v is not None]
        for s in shares if vs else []:
            if g == "inf" and 0 < s * 4 < 1:
                continue  # between -inf and a number there is no number
            at, ordered = s * (len(vs) - 1), sorted(vs, key=lambda x: (x != x, x))
            a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
            want = a if a == b else a + (b - a) * (at - math.floor(at)) if g in ("nan", "inf") else float(np.percentile(np.sort(vs), 100 * s))
            assert got[g, s] == pytest.approx(want, rel=1e-12, nan_ok=True), (g, s)
    assert not any(g == "empty" for g, _ in got)
    whole = quantiles.percentiles(df.filter("g = 'hot'"), [], "v", [0.5], few, grid).collect()
    assert len(whole) == 1 and whole[0].value == pytest.approx(float(np.median(groups["hot"])), rel=1e-12)


def test_percentiles_of_ten_million_values_of_one_group(spark):
    """No list of a group's values is held: the plan of every pass is a sketch and counts."""
    n = 10_000_000
    df = spark.range(n, numPartitions=16).select(F.lit(1).alias("g"), ((F.col("id") * 7_919) % n / 4).alias("v"))
    got = {r.share: r.value for r in quantiles.percentiles(df, ["g"], "v", [0.5, 0.9]).collect()}
    assert got == {s: pytest.approx(s * (n - 1) / 4, rel=1e-12) for s in (0.5, 0.9)}


@pytest.mark.parametrize("run", [4_096, 3])
def test_rate_gate_follows_the_queue(spark, run):
    from datetime import datetime, timedelta

    from rankspark.operators import ledger

    rng, rows, seq = random.Random(run), [], 0
    for key, n in (("hot", 400), ("b", 7), (None, 20), ("c", 1)):
        t = 0.0
        for _ in range(n):
            t += rng.choice([0, 0, 1, 5, 30, 200]) * rng.random()
            rows.append((seq, key, datetime(2026, 1, 1) + timedelta(seconds=round(t, 3))))
            seq += 1
    df = spark.createDataFrame(rows, "seq long, k string, ts timestamp").repartition(6)
    got = {r.seq: r.waited for r in ledger.rate_gate(df, ["k"], "ts", "seq", 4, 60, run).collect()}
    starts, want = defaultdict(list), {}
    for s, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        own = starts[k]
        begin = max(t, own[-4] + timedelta(seconds=60)) if len(own) >= 4 else t
        own.append(begin)
        want[s] = round((begin - t) / timedelta(microseconds=1))
    assert got == want and max(want.values()) > 60e6
