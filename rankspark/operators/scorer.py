"""External scorers and embedders over an injected callable: cache first, bounded concurrency, a rate limit, a spend gate, retries.

run_batch() is what one task does with its jobs; score_misses() deals the jobs out to tasks and gives each its share of the
limits, so that no task needs to know of the others.
"""

from __future__ import annotations

import math
import threading
import time
from collections import deque
from collections.abc import Callable, Hashable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RETRYABLE
from ..sources.scratch import cut
from ..sources.tables import spread

BACKOFF, MAX_CONCURRENCY, MAX_RETRIES, EMBED_BATCH = (1.0, 2.0, 4.0), 16, 3, 32  # fixed values
TASK_BYTES, TEXT_BYTES = 256 << 20, 16 << 20  # of a task's keys and texts, of texts that are broadcast


class ScoringError(Exception):
    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


class CeilingReached(Exception):
    """A call that the spend gate refuses."""


def is_retryable(e: ScoringError) -> bool:
    """A retryable status, or a timeout without any status."""
    late = any(s in str(e).lower() for s in ("timed out", "timeout"))
    return late if e.status is None else e.status in RETRYABLE


def with_retries(call: Callable[[], object], retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep):
    for attempt in range(retries + 1):
        try:
            return call()
        except ScoringError as e:
            if attempt == retries or not is_retryable(e):
                raise
            sleep(max(BACKOFF[min(attempt, len(BACKOFF) - 1)], e.retry_after or 0.0))
    raise AssertionError


class RateGate:
    """At most `per_minute` starts in any 60 seconds; the others wait."""

    def __init__(self, per_minute: int | None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.most, self.sleep, self.clock = per_minute, sleep, clock
        self.starts: deque[float] = deque()
        self.lock = threading.Lock()

    def wait(self) -> None:
        while self.most:
            with self.lock:
                now = self.clock()
                while self.starts and self.starts[0] <= now - 60.0:
                    self.starts.popleft()
                if len(self.starts) < self.most:
                    self.starts.append(now)
                    return
                rest = self.starts[0] + 60.0 - now
            self.sleep(max(rest, 0.01))


class SpendGate:
    """Reserves a call's estimate before it starts, and puts the actual cost in its place; a failed call keeps its reservation, a refused one has none."""

    def __init__(self, ceiling: float | None = None, spent: float = 0.0):
        if any(x is not None and (not math.isfinite(x) or x < 0) for x in (ceiling, spent)):
            raise ValueError("spend values must be finite and not negative")
        self.ceiling, self.spent, self.lock = ceiling, spent, threading.Lock()

    def reserve(self, estimate: float) -> None:
        if not math.isfinite(estimate) or estimate < 0:
            raise ValueError("an estimate must be finite and not negative")
        with self.lock:
            if self.ceiling is not None and self.spent + estimate > self.ceiling + 1e-12:
                raise CeilingReached(f"ceiling {self.ceiling:.6f}: {self.spent:.6f} spent, {estimate:.6f} more wanted")
            self.spent += estimate

    def settle(self, estimate: float, actual: float | None) -> None:
        if actual is not None:
            with self.lock:
                self.spent += actual - estimate


@dataclass(frozen=True)
class Outcome:
    result: object = None
    status: str = "ok"  # ok, skipped: ..., failed: ...
    attempts: int = 0


def run_batch(jobs: Sequence[tuple[Hashable, object, float]], call: Callable[[object], object], *, concurrency: int = MAX_CONCURRENCY, rate: RateGate | None = None, spend: SpendGate | None = None,
              retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep, actual: Callable[[object], float | None] = lambda _: None) -> list[Outcome]:
    """Outcomes of (key, payload, estimate) jobs in their order; jobs of one key share one call, at most MAX_CONCURRENCY run at a time."""
    if concurrency < 1:
        raise ValueError("concurrency must be 1 at least")
    rate, spend = rate or RateGate(None), spend or SpendGate()

    def work(payload: object, estimate: float) -> Outcome:
        tries = 0

        def attempt() -> object:
            nonlocal tries
            rate.wait()
            spend.reserve(estimate)
            tries += 1
            got = call(payload)
            spend.settle(estimate, actual(got))
            return got

        try:
            return Outcome(with_retries(attempt, retries, sleep), "ok", tries)
        except CeilingReached as e:
            return Outcome(None, f"skipped: {e}", tries)
        except ScoringError as e:
            return Outcome(None, f"failed: {e}", tries)

    first = {key: (payload, estimate) for key, payload, estimate in reversed(jobs)}
    order = dict.fromkeys(key for key, _, _ in jobs)
    if concurrency == 1:  # a thread for each call would cost more than a short call
        done = {key: work(*first[key]) for key in order}
        return [done[key] for key, _, _ in jobs]
    with ThreadPoolExecutor(min(concurrency, MAX_CONCURRENCY)) as pool:
        running = {key: pool.submit(work, *first[key]) for key in order}
        return [running[key].result() for key, _, _ in jobs]


def score_misses(wanted: DataFrame, cache: DataFrame, call: Callable[[str, str], float], max_concurrency: int = MAX_CONCURRENCY, sleep: Callable[[float], None] = time.sleep, per_minute: int | None = None, ceiling: float | None = None, estimate: float = 0.0, ids: tuple[str, str] | None = None) -> DataFrame:
    """(cache_key, score, status) for distinct keys without a cache entry; a failed or skipped call gives a null score.

    wanted: cache_key, state, question. One call at a time in each of max_concurrency tasks; each task has its share of the
    rate and of the ceiling. Where these tasks would read more than TASK_BYTES each, the keys are dealt into waves, which run
    one after another, so that neither the calls at once nor a task's share grow with the input. ids: columns of wanted, without
    nulls, that tell its states and its questions apart, else their digests do. Only keys and ids are dealt out by key and
    written; texts join them behind that, so that none is shuffled once for each of its pairs.
    """
    bytes_of = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    digest = lambda c: F.coalesce(F.unhex(F.sha2(c, 256)), F.lit(b""))
    s, q = (F.col(c) for c in ids) if ids else (digest("state"), digest("question"))
    wanted = wanted.select("cache_key", "state", "question", s.alias("_s"), q.alias("_q"))
    size = F.octet_length("cache_key") + bytes_of("state") + bytes_of("question")
    todo = wanted.select("cache_key", "_s", "_q", size.alias("size")).dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    todo = cut(todo)
    waves = max(1, -(-(todo.agg(F.sum("size")).first()[0] or 0) // (max_concurrency * TASK_BYTES)))
    todo = todo.drop("size")
    states, questions = (cut(wanted.select(i, c).distinct()) for i, c in (("_s", "state"), ("_q", "question")))
    few = [(t.agg(F.sum(bytes_of(F.col(c)))).first()[0] or 0) <= TEXT_BYTES for t, c in ((states, "state"), (questions, "question"))]
    wave = F.pmod(F.shiftright(F.xxhash64("cache_key"), 20), F.lit(waves))
    if waves > 1:
        todo = cut(todo.withColumn("wave", wave).repartitionByRange(int(waves), "wave").sortWithinPartitions("wave"))
    rate = None if per_minute is None else max(1, per_minute // max_concurrency)
    share = None if ceiling is None else ceiling / max_concurrency / waves

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, spend = RateGate(rate, sleep), SpendGate(share)
        for pdf in batches:
            jobs = [(key, (state, question), estimate) for key, state, question in pdf.itertuples(index=False)]
            out = []
            for (key, _, _), o in zip(jobs, run_batch(jobs, lambda p: float(call(*p)), concurrency=1, rate=gate, spend=spend, sleep=sleep), strict=True):
                fine = o.status == "ok" and 0.0 <= o.result <= 1.0
                out.append((key, o.result if fine else None, "out of range" if o.status == "ok" and not fine else o.status))
            yield pd.DataFrame(out, columns=["cache_key", "score", "status"])

    def scored(keys: DataFrame) -> DataFrame:
        texts = spread(keys, max_concurrency) if all(few) else keys
        for t, i, broadcast in ((questions, "_q", few[1]), (states, "_s", few[0])):
            texts = texts.join(F.broadcast(t) if broadcast else t, i)
        return texts.select("cache_key", "state", "question").coalesce(max_concurrency).mapInPandas(run, f"cache_key {dict(keys.dtypes)['cache_key']}, score double, status string")

    if waves == 1:
        return scored(todo)
    done = [cut(scored(todo.filter(F.col("wave") == w).drop("wave"))) for w in range(waves)]
    return reduce(DataFrame.unionByName, done)


def score_shortlist(pairs: DataFrame, cache: DataFrame, call: Callable[[str, str], float], **options) -> DataFrame:
    """Every wanted row with its cached or new score; rows of one key share one call."""
    new = score_misses(pairs, cache, call, **options)
    known = cache.select("cache_key", "score", F.lit("cached").alias("status")).unionByName(new)
    return pairs.join(known, "cache_key", "left")


def embed_texts(texts: DataFrame, key: str, text: str, call: Callable[[list[str]], list[list[float]]], size: int = EMBED_BATCH, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, embedding, status): one call for each run of `size` texts of a task; a failed call gives its texts null vectors."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                try:
                    got, status = with_retries(lambda: call(list(part[text])), sleep=sleep), "ok"  # noqa: B023
                    if len(got) != len(part):
                        got, status = [None] * len(part), f"failed: {len(got)} vectors for {len(part)} texts"
                except ScoringError as e:
                    got, status = [None] * len(part), f"failed: {e}"
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": pd.Series(got, dtype=object), "status": status})

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<double>, status string")


def overlap_scorer(state: str, question: str) -> float:
    """A deterministic stand-in for a model: share of the question's words that the state holds."""
    words = set((question or "").lower().split())
    return len(words & set((state or "").lower().split())) / max(1, len(words))
