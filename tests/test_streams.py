"""The ledger as a stream of files, against the same rules over lists."""

import datetime as dt

import pytest

from rankspark.streaming import ledger as L

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = dt.datetime(2026, 1, 1)


@pytest.fixture()
def files(spark, tmp_path):
    rows = [(i, START + dt.timedelta(minutes=7 * i), i % 3, "view" if i % 2 else "buy", float(i % 5), "{}") for i in range(60)]
    late = [(1000, START + dt.timedelta(days=3), 9, "view", 1.0, "{}")]  # moves the watermark past all others
    for k, part in enumerate((rows[:30], rows[30:] + rows[25:30], late)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events/{k}")
    return rows, f"file://{tmp_path}/events/*", tmp_path


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").collect()


def test_repeated_events_count_once(spark, files):
    rows, path, _ = files
    got = drained(spark, L.deduplicated(L.read_events(spark, path, 1)), "dedup")
    assert sorted(r.event_id for r in got) == [*range(60), 1000]


def test_tumbling_cost(spark, files):
    rows, path, _ = files
    got = drained(spark, L.tumbling_cost(L.deduplicated(L.read_events(spark, path, 1))), "tumbling")
    want = {}
    for _, ts, _, kind, value, _ in rows:
        key = (ts.replace(minute=0), kind)
        n, s = want.get(key, (0, 0.0))
        want[key] = (n + 1, s + value)
    assert {(r.start.replace(tzinfo=None), r.event_type): (r.calls, r.value) for r in got} == want


def test_sessions_end_with_a_gap(spark, files):
    rows, path, _ = files
    got = drained(spark, L.sessions(L.deduplicated(L.read_events(spark, path, 1)), "25 minutes"), "sessions")
    assert sorted((r.user_id, r.calls) for r in got) == [(0, 20), (1, 20), (2, 20)]


def test_refused_calls_reserve_nothing(spark, files):
    rows, path, _ = files
    got = {r.event_id: (r.spent, r.allowed) for r in drained(spark, L.spend_gate(L.deduplicated(L.read_events(spark, path, 1)), 20.0), "gate")}
    for user in range(3):
        spent = 0.0
        for i, _, _, _, value, _ in (r for r in rows if r[2] == user):
            fits = spent + value <= 20.0
            spent += value if fits else 0.0
            assert got[i] == (spent, fits)
    assert not all(ok for _, ok in got.values())


def test_the_ledger_table_grows_by_new_keys(spark, files):
    rows, path, folder = files
    table = f"file://{folder}/table"
    for _ in range(2):  # the second run finds nothing new
        L.append_batches(L.read_events(spark, path, 1), table, f"file://{folder}/checkpoint", "event_id").awaitTermination()
    L.append_batches(L.read_events(spark, path, 1), table, f"file://{folder}/another", "event_id").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(table).collect()) == [*range(60), 1000]


def test_reservations_are_settled_expire_or_come_late(spark, tmp_path):
    from pyspark.sql import functions as F

    at = lambda s: dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    batches = [
        [(1, 0, "a", "reserve", "a1", 0.4), (2, 1, "a", "reserve", "a2", 0.4), (3, 2, "a", "reserve", "a3", 0.4), (4, 0, "b", "reserve", "b1", 1.0), (5, 1, "b", "reserve", "b2", 1e-13), (6, 2, "b", "reserve", "b3", None), (7, 3, "b", "reserve", "b4", -1.0)],
        [(8, 10, "a", "settle", "a1", 0.1), (9, 11, "a", "reserve", "a3", 0.4), (10, 12, "a", "settle", "a2", None), (11, 13, "a", "reserve", "a3", 0.4), (12, 10, "b", "settle", "b1", 0.25)],
        [(13, 200, "a", "settle", "a3", 0.3), (14, 201, "c", "reserve", "c1", 0.9)],  # a3 expired before it was settled
        [(15, 5_000, "d", "reserve", "d1", 0.1)],  # moves the watermark past c1
        [(16, 5_001, "d", "settle", "nobody", 0.2)],
    ]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(i, at(s), k, kind, a, u) for i, s, k, kind, a, u in rows], "event_id long, ts timestamp, key string, kind string, attempt string, usd double")
        df.coalesce(1).write.parquet(f"file://{tmp_path}/events/{n}")
    schema = spark.read.parquet(f"file://{tmp_path}/events/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events/*").withWatermark("ts", "10 seconds")
    got = drained(spark, L.spend_events(stream, 1.0, 60_000), "spend_events")
    seen = {}
    for r in got:
        seen.setdefault(r.key, []).append((r.attempt, r.outcome, r.spent))
    assert seen["a"] == [("a1", "allowed", 0.4), ("a2", "allowed", 0.8), ("a3", "refused", 0.8), ("a1", "settled", 0.5), ("a3", "allowed", 0.9), ("a2", "kept", 0.9), ("a3", "repeated", 0.9), ("a3", "expired", 0.5), ("a3", "late", 0.8)]
    assert seen["b"] == [("b1", "allowed", 1.0), ("b2", "allowed", 1.0), ("b3", "invalid", 1.0), ("b4", "invalid", 1.0), ("b1", "settled", 0.25), *seen["b"][5:]] and seen["b"][5:] in ([], [("b2", "expired", 0.25)])
    assert seen["c"] == [("c1", "allowed", 0.9), ("c1", "expired", 0.0)] and seen["d"][:2] == [("d1", "allowed", 0.1), ("nobody", "late", 0.3)]
