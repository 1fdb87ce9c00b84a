"""The usage ledger as a stream: dedupe within a watermark, tumbling cost, session windows, keyed spend gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16, delay: str = "1 hour") -> DataFrame:
    """A directory of event files as a stream; ts becomes an instant with the one watermark that all operators go by."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """First arrival of each attempt; state is dropped once the watermark has passed."""
    return events.dropDuplicatesWithinWatermark([key])


def tumbling_cost(events: DataFrame, size: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "calls", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = events.groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("calls")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "calls")


def spend_gate(events: DataFrame, ceiling: float, key: str = "user_id", cost: str = "value") -> DataFrame:
    """(key, event_id, spent, allowed): a call is allowed while the key's reserved spend stays under the ceiling.

    A refused call reserves nothing. State is one double a key.
    """
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for event, c in zip(rows["event_id"], rows[cost].fillna(0.0), strict=True):
            ok = spent + c <= ceiling + 1e-12
            spent += c if ok else 0.0
            out.append((k[0], event, round(spent, 9), ok))
        state.update((spent,))
        yield pd.DataFrame(out, columns=["key", "event_id", "spent", "allowed"])

    return events.groupBy(key).applyInPandasWithState(step, "key long, event_id long, spent double, allowed boolean", "spent double", "append", GroupStateTimeout.NoTimeout)


def spend_events(events: DataFrame, ceiling: float, ttl_ms: int) -> DataFrame:
    """(key, attempt, outcome, spent) of reservations and settlements (key, ts, event_id, kind, attempt, usd) under a watermark on ts.

    A reservation counts as spent until it is settled; it is refused if it doesn't fit under the ceiling, and invalid without a
    finite cost of 0 or more. A settlement puts the actual cost in its place; without one (null) the reservation stays for good.
    An open reservation expires ttl_ms after its time: with the next event of its key, or by a timer as the watermark passes. What
    is settled after that was spent all the same: it is late, and adds its cost. State: one sum and the open reservations.
    """
    names = ["key", "attempt", "outcome", "spent"]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, ids, costs, ends = state.get if state.exists else (0.0, [], [], [])
        held = {i: (c, e) for i, c, e in zip(ids, costs, ends, strict=True)}
        out: list[tuple] = []

        def expire(now: int) -> None:
            nonlocal spent
            for i in sorted((i for i, (_, e) in held.items() if 0 <= e <= now), key=lambda i: (held[i][1], i)):
                spent -= held.pop(i)[0]
                out.append((k[0], i, "expired", round(spent, 9)))

        if state.hasTimedOut:
            expire(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for ts, kind, attempt, usd in zip(rows["ts"], rows["kind"], rows["attempt"], rows["usd"], strict=True):
                now = int(ts.timestamp() * 1000)
                expire(now)
                known = usd is not None and usd == usd
                if kind == "reserve":
                    fits = known and 0 <= usd < float("inf")
                    outcome = "invalid" if not fits else "repeated" if attempt in held else "allowed" if spent + usd <= ceiling + 1e-12 else "refused"
                    if outcome == "allowed":
                        held[attempt] = (usd, now + ttl_ms)
                        spent += usd
                elif attempt in held:
                    outcome = "settled" if known else "kept"
                    if known:
                        spent += usd - held.pop(attempt)[0]
                    else:
                        held[attempt] = (held[attempt][0], -1)  # never expires
                else:
                    outcome = "late"
                    spent += usd if known else 0.0
                out.append((k[0], attempt, outcome, round(spent, 9)))
        state.update((spent, list(held), [c for c, _ in held.values()], [e for _, e in held.values()]))
        if soon := [e for _, e in held.values() if e >= 0]:
            state.setTimeoutTimestamp(max(min(soon), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    kind = dict(events.dtypes)["key"]
    wanted = events.select("key", "ts", "event_id", "kind", "attempt", F.col("usd").cast("double").alias("usd"))
    return wanted.groupBy("key").applyInPandasWithState(step, f"key {kind}, attempt string, outcome string, spent double", "spent double, ids array<string>, costs array<double>, ends array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def append_batches(stream: DataFrame, path: str, checkpoint: str, key: str, buckets: int = 64):
    """Append-only ledger sink: each micro-batch adds the keys that the table lacks. The table is split by the key's bucket, so a batch reads its own buckets only."""
    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets).cast("long")).cast("int"))
        try:
            known = spark.read.parquet(path).select("bucket", key)
            known = known.join(new.select("bucket").distinct(), "bucket", "left_semi").select(key)  # reads the batch's buckets
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # the first batch finds no table
                raise
            known = batch.select(key).limit(0)
        new.join(known, key, "left_anti").write.mode("append").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
