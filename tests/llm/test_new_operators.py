"""Delta-maintained Lloyd, subword toxicity and MaxScore search against plain versions."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankspark.llm import kernels, lloyd, maxscore, terms, toxicity

# --- op11 ---------------------------------------------------------------------------------------------------------------------------


def plain_lloyd(rows, rounds, parts=16, entries=64):
    """{id: [(code, error)]}, books; rows of one length."""
    kept = sorted(((i is None, i or 0, [math.floor(256 * x) for x in v], i, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (*r[:2], np.array(r[2], np.int64).tobytes()))
    w = [c[1] - c[0] for c in zip(lloyd.cuts(len(kept[0][2]), parts)[:-1], lloyd.cuts(len(kept[0][2]), parts)[1:])]
    at = np.concatenate(([0], np.cumsum(w))).tolist()
    books = [[k[2][at[p] : at[p + 1]] for k in kept[:entries]] for p in range(parts)]

    def near(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for k in kept:
            for p in range(parts):
                groups[p, near(k[2][at[p] : at[p + 1]], p)[1]].append(k[2][at[p] : at[p + 1]])
        for (p, e), own in groups.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for k in kept:
        found = [near(k[2][at[p] : at[p + 1]], p) for p in range(parts)]
        out.append((k[3], k[4], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    by_label = Counter()
    for _, label, _, error in out:
        by_label[label] += error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i is None, i or 0, code, error, by_label[label], sha) for i, label, code, error in out))


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, d))
    return (base[rng.integers(0, 9, n)] + 0.3 * rng.normal(size=(n, d))).round(3)


@pytest.mark.parametrize(("d", "n"), [(32, 150), (16, 20), (37, 90), (5, 80)])
def test_lloyd_against_plain_rounds(spark, d, n):
    x = vectors(n, d, d)
    rows = [(i if i % 11 else i // 2, [float(c) for c in v], None if i % 4 == 0 else i % 3) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [float("nan")] * d, 1), (1002, [None] + [0.5] * (d - 1), 2), (1003, [float("inf")] * d, 2), (None, [0.25] * d, 2), (1004, [0.0] * d, None), *rows[:3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in lloyd.compressed(df).collect())
    assert got == plain_lloyd(rows, 2)


def test_lloyd_by_length_and_empty_tables(spark):
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(vectors(70, 16, 1))]
    more = [(100 + i, [float(c) for c in v], 1) for i, v in enumerate(vectors(66, 32, 2))] + [(300, [], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    got = lloyd.compressed(spark.createDataFrame(rows + more, schema)).collect()
    alone = {r.vec_id: r for d in (rows, more[:-1]) for r in lloyd.compressed(spark.createDataFrame(d, schema)).collect()}
    assert len(got) == 137 and all((r.code, r.error, r.codebooks_sha256) == (alone[r.vec_id].code, alone[r.vec_id].error, alone[r.vec_id].codebooks_sha256) for r in got if r.vec_id < 300)
    assert next(r for r in got if r.vec_id == 300).code == "00" * 16
    assert lloyd.compressed(spark.createDataFrame([], schema)).collect() == []
    assert lloyd.compressed(spark.createDataFrame([(1, None, 1)], schema)).collect() == []


def test_lloyd_sums_are_kept_by_what_changed(spark):
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(vectors(400, 32, 5))], "vec_id long, embedding array<double>, label int").repartition(3)
    state, books, sums = lloyd.train(df, "vec_id", "embedding", "label", 2)
    # the running sums are those of all parts as they stand after the second assignment
    at, want = lloyd.cuts(32), Counter()
    for r in state.collect():
        x, code = np.frombuffer(r.x, np.int64), np.frombuffer(r.code, np.uint8)
        for p in range(16):
            for j in range(at[p + 1] - at[p]):
                want[p, int(code[p]), j] += int(x[at[p] + j])
    got = {(r.part, r.entry, r.place): r.total for r in sums.collect() if r.n}
    assert got == dict(want)
    # the second round's rows hold only parts that moved, each once as plus and once as minus
    d = [e for r in state.filter("changed is not null").collect() for e in r.changed]
    assert sum(e.n for e in d) == 0 and 0 < sum(e.n for e in d if e.n > 0) < 400 * 16 / 2


def test_lloyd_large_numbers_stay_in_64_bits():
    big = lloyd.whole(pa.array([[1e300, -1e300, 3.0]]), 3)
    assert big.tolist() == [[lloyd.bound(3), -lloyd.bound(3), 768]]
    x = np.array([[lloyd.bound(2), -lloyd.bound(2)], [5, 5]])
    best, least = lloyd.nearest(x, np.array([[-lloyd.bound(2), lloyd.bound(2)], [5, 5], [5, 5]]))
    assert best.tolist() == [1, 1] and least.tolist() == [2 * (lloyd.bound(2) - 5) ** 2 + 20 * lloyd.bound(2), 0]


# --- op13 ---------------------------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(words_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_all, l_all = len(bags), sum(n for *_, n in bags)
    df, wanted, out = Counter(w for _, b, _ in bags for w in b), defaultdict(Counter), {}
    for i, t in items:
        wanted[i].update(words_of(t))
    for i, q in wanted.items():
        found = []
        for d, b, n in bags:
            m = 100 - 25 + (25 * n * n_all) // l_all
            s = sum(c * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 12 * m)) for w, c in q.items() if b[w])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out[i] = [(r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return {i: v for i, v in out.items() if v}


def corpus(n, seed):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}é" for i in range(400)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "-- ,;"), (None, docs[0][1]), (3, docs[5][1]), (n + 3, docs[5][1]), (n + 4, "W1,w1/W1 R3é " * 900)]
    items = [(i, " ".join(rng.choice(common + rare) for _ in range(rng.randrange(1, 25)))) for i in range(15)]
    return docs, [*items, (50, None), (51, "nowhere"), (52, "w1 w1 W1 r3é"), (None, "w2 r7é"), (4, "r9é r9é w3")]


@pytest.mark.parametrize(("size", "block", "k"), [(1 << 21, 100_000, 20), (400, 30, 3), (150, 60, 20)])
def test_maxscore_against_all_scores(spark, monkeypatch, size, block, k):
    monkeypatch.setattr(maxscore, "BLOCK_PAIRS", block)
    docs, items = corpus(260, size)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hashes string").repartition(3)
    shards = maxscore.index(d, "doc_id", "text", size, 10)
    assert shards.count() >= (3 if size > 1000 else 12)
    got = defaultdict(list)
    for r in maxscore.search(shards, spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", k).orderBy("item", "rank").collect():
        got[r["item"]].append((r["rank"], r.doc, r.score))
    assert dict(got) == plain_search(docs, items, k)


def test_maxscore_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for docs, items in ((none, some), (some, none), (none, none)):
        assert maxscore.search(maxscore.index(docs, "doc_id", "text"), items, "doc_id", "text", 5).collect() == []


def test_maxscore_skips_postings():
    """Rare terms decide; the lists of common ones are probed for few documents."""
    rng = np.random.default_rng(3)
    hashes = [np.sort(np.concatenate((np.arange(1, 9), rng.integers(100, 2_000, 4)))).astype(np.uint64) for _ in range(3_000)]
    row = maxscore.shard(np.arange(3_000), np.array([len(h) for h in hashes]), np.concatenate(hashes))
    wanted = np.unique(np.concatenate((np.arange(1, 9), [150, 151, 152]))).astype(np.uint64)
    df = np.array([sum(w in h for h in hashes) for w in wanted.tolist()])
    weights = np.floor(1000 * np.log((2 * 3_000 + 2) / (2 * df + 1))).astype(np.int64)
    best = maxscore.Best(1, 2)
    read, whole = maxscore.search_shard(row, wanted, weights, [(np.arange(len(wanted)), np.ones(len(wanted), np.int64))], 3_000, 36_000, best)
    assert read < whole / 10 and len(best.scores[0]) == 2


def test_maxscore_index_keeps_postings_only(spark):
    """Counts above 255 don't make all counts eight bytes wide, texts come in small batches, and a task holds little more than the postings."""
    row = maxscore.shard(np.arange(2), np.array([300, 4]), np.array([7] * 300 + [5, 5, 7, 9], np.uint64))
    assert len(row["tfs"]) == 2 * 4 and np.frombuffer(row["tfs"], "<u2").tolist() == [2, 300, 1, 1]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    maxscore.index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", "text")
    assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= kernels.BATCH_BYTES
    words = [f"w{i}" for i in range(20_000)]
    rng = random.Random(1)
    texts = [" ".join(rng.choices(words[: 20 if i % 2 else None], k=500)) for i in range(1_000)]
    batches = [pa.record_batch([pa.array(range(i, i + 100)), pa.array(texts[i : i + 100])], names=["doc", "text"]) for i in range(0, 1_000, 100)]
    kernels.words(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))  # its tables of powers stay with the worker
    tracemalloc.start()
    got = list(maxscore.shards_of(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 and got[0].column("terms")[0].as_py() == 500_000
    assert peak < 40 * 500_000  # bytes a term: 21, but 66 when all hashes were kept


# --- op12 ---------------------------------------------------------------------------------------------------------------------------

RUDE = ("wretchling", "stinkbrain", "vileface", "grubhead")


def rated(n, seed):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ras", "ul", "po", "shi", "en", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(RUDE)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxic_texts_and_misspellings_are_found(spark):
    docs, labels = rated(600, 1)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(d, y.filter(~toxicity.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in toxicity.score(d, model, [F.col("doc_id"), toxicity.held_out(F.col("doc_id")).alias("held_out")]).collect()}
    out = [(y, got[i].predicted) for i, y in labels if got[i].held_out]
    assert len(out) > 80 and sum(a == b for a, b in out) >= 0.97 * len(out)
    clean = "ka lo miten rasul po shi endor ka ulpo tenmi " * 3
    long = clean * 300
    probes = [(1, clean + "you WRETCHLING, " + clean), (2, long + " wretchlng " + long), (3, clean + " stinkbrrain"), (4, "grubhaed vilefacee"), (5, clean), (6, long), (7, None), (8, ""), (9, "?! ..")]
    scored = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(probes, "doc_id long, text string"), model, [F.col("doc_id")]).collect()}
    assert [scored[i].predicted for i in range(1, 10)] == [1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert scored[7].score == scored[8].score == scored[9].score and all(0 <= r.score <= 1 for r in scored.values())


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    words = ["abc", "abcd", "xyz", "klm", "q"]
    s, w = toxicity.slots(words)
    seen, place = np.unique(s, return_inverse=True)
    share = 1 / np.bincount(w)[w]
    bounds = np.array([0, 9, 12, 30, 30])
    each, toxic = rng.integers(0, 5, 30), np.array([1, 0, 0, 1])
    new = toxicity.fresh(each, bounds).astype(float)
    m = toxicity.Model(seen)
    keep = np.where(rng.random(len(seen)) < 0.5, 0.0, 2.0)
    args = ((place, w, share), each, bounds, new, toxic, keep, len(words))
    # the pull of passages is held as it is within a step, so with one passage a text the gradient is that of the loss
    short = (args[0], each[:12], np.array([0, 5, 12]), new[:12], np.array([1, 0]), keep, len(words))
    _, d = toxicity.gradients(m, *short)
    for part, grad in zip(m.parts(), d, strict=True):
        for at in [tuple(rng.integers(0, n) for n in part.shape) for _ in range(6)]:
            kept, h = part[at], 1e-6
            part[at] = kept + h
            up = toxicity.gradients(m, *short)[0] + toxicity.DECAY / 2 * (m.e**2).sum()
            part[at] = kept - h
            down = toxicity.gradients(m, *short)[0] + toxicity.DECAY / 2 * (m.e**2).sum()
            part[at] = kept
            assert abs((up - down) / (2 * h) - grad[at]) < 1e-6
    assert toxicity.gradients(m, *args)[0] > 0


def test_passages_and_repeats():
    bounds = np.array([0, 0, 3, 23])
    a, b, t = toxicity.passages(bounds, 1)
    assert (t == 1).sum() == 1 and (t == 2).sum() == 13 and b.max() == 23 and (b - a)[t == 2].min() == toxicity.WINDOW
    a, b, t = toxicity.passages(bounds, 4)
    assert b.max() == 23 and (t == 2).sum() == 4
    w = np.array([5, 5, 5, 1, 2, 3, 4, 6, 7, 8, 9, 5])
    assert toxicity.fresh(w, np.array([0, 2, 12])).tolist() == [True, False, True, *[True] * 9]


def test_toxicity_without_labels_and_with_one_class(spark):
    d = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    y = "doc_id long, toxic int"
    for labels, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(None, 1), (1, None)], 0.0)):
        model = toxicity.learn(d, spark.createDataFrame(labels, y))
        assert [(r.score, r.predicted) for r in toxicity.score(d, model, [F.col("doc_id")]).collect()] == [(want, int(want))] * 2


def test_toxicity_sample_is_bounded_and_of_ids_at_hand(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    monkeypatch.setattr(toxicity, "WORDS", 128)
    docs, labels = rated(200, 3)
    docs[1] = (1, "word " * 1_000)
    absent = [(10_000 + i, i % 2) for i in range(3_000)]  # labels whose documents a filter took
    rows = toxicity.training_texts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + absent, "doc_id long, toxic int")).collect()
    assert Counter(r.toxic for r in rows) == {0: 20, 1: 20} and max(len(r.each) // 4 for r in rows) <= 128


def test_terms_are_those_of_the_pattern():
    texts = ["Ab-c 12é_x\x7fY", "", "ÄB ÉÑ", "a" * (kernels.PIECE + 10) + "-b", "...", "x y z w"]
    data, offsets = kernels.buffers(pa.array(texts))
    h, starts, bounds = terms.terms(data, offsets)
    assert terms.spelled(data, offsets, starts) == [w for t in texts for w in words_of(t)]
    assert np.diff(bounds).tolist() == [len(words_of(t)) for t in texts]
    assert len(set(h.tolist())) == len({w for t in texts for w in words_of(t)})


def test_hubs_of_components_can_be_split(spark):
    """Half of all edges at one id: the join with the written minima is split by adaptive execution."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        e = kernels.cut(spark.range(40_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("u"), (F.col("id") + 100_000).alias("v")))
        first = kernels.cut(e.groupBy("u").agg(F.min("v").alias("m")))
        joined = e.join(first, "u").select("v", "m").distinct()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        got = {r.component for r in kernels.components(e.filter("u < 2000"), "u", "v").collect()}
        assert 1 in got and len(got) == 1_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_labels_of_absent_documents_take_no_place(spark, monkeypatch):
    from rankspark.llm import quality

    monkeypatch.setattr(quality, "SAMPLE", 10)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1_000 + i, 1, 0) for i in range(5_000)], "doc_id long, quality int, toxic int")
    assert quality.training_rows(docs, labels).count() == 10


@pytest.mark.parametrize("open_lines", [1, 40])
def test_lines_held_are_dealt_to_asking_blocks_only(spark, monkeypatch, open_lines):
    """A segment of 5,000 lines of which few are open deals two rows a line at most, in blocks of 64."""
    from rankspark.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", 64)
    n, dealt = 5_000, spark.sparkContext.accumulator(0)
    cells = spark.createDataFrame([(7, i, i) for i in range(n)], "cell long, h long, first long")
    words = [list(range(1, 11))] * (n - open_lines) + [[*range(1, 8), 80 + i, 90 + i, 100 + i] for i in range(open_lines)]
    sketch = spark.createDataFrame([(i, bytearray(np.array(w, np.uint16).tobytes())) for i, w in enumerate(words)], "h long, words binary")
    done = spark.createDataFrame([(i,) for i in range(n - open_lines)], "h long")
    plain = type(cells.groupBy("cell")).applyInArrow

    def counted(group, f, schema):
        def run(table):
            dealt.add(table.num_rows)
            return f(table)

        return plain(group, run, schema)

    monkeypatch.setattr(type(cells.groupBy("cell")), "applyInArrow", counted)
    got = {r.h for r in line_dedup._follows_any(cells, sketch, done).collect()}
    assert got == set(range(n - open_lines, n)) and dealt.value <= 2 * n
