"""Operators do the whole job where tables, texts or sources are larger than those of the other tests."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankspark.llm import ann, itq, langid, line_dedup, mixing, quality, urls


def test_a_template_recurs_in_a_leaf_of_any_size(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"session opened for {name(i)} by the login service today\nline{name(i)}") for i in range(2_500)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {i: t if i == 0 else t.split("\n")[1] for i, t in rows}


def random_lines(seed, n):
    """Lines of few leaves that share segments, agree in part or come again; several to a document."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            m = rng.choice([4, 5, 6, 7, 10, 13])
            lines.append(" ".join(["aa", "bb", "cc", *(rng.choice("xyzuvw"[: rng.choice([2, 6])]) for _ in range(m - 3))]))
        out.append((i % (n - 5), "\n".join(lines)))  # the last five repeat ids
    return out


@pytest.mark.parametrize("block", [4, 2_048])
def test_lines_against_all_pairs_of_their_leaves(spark, monkeypatch, block):
    from test_pipeline import lines_by_hand

    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = [(i, t, "en", "s", 0) for i, t in random_lines(block, 150)]
    got = line_dedup.deduplicated(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in lines_by_hand(rows))


def test_recurring_means_in_other_documents(spark):
    short = "a b\nc d\ne f\ng h\ni j"
    rows = [(1, short), (2, short), *[(3, "one line of six words here")] * 5, *[(4, "five times in 2 rows")] * 2]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and all(r._dropped == 0 for r in got)


def plain_url_score(url, seen):
    """Log-likelihood ratio per byte by dictionaries of exact counts, orders 0 to 5."""
    total = 0.0
    padded = lambda u: b"\0" * 5 + u.encode()
    for sign, label in ((1, "allow"), (-1, "block")):
        cells = Counter()
        for u in seen[label]:
            t = padded(u)
            cells.update((k, t[i - k : i], t[i]) for i in range(5, len(t)) for k in range(6))
        n, followers = Counter(), Counter()
        for (k, context, _), c in cells.items():
            n[k, context] += c
            followers[k, context] += 1
        t = padded(url)
        for i in range(5, len(t)):
            p = 1 / 256
            for k in range(6):
                key = (k, t[i - k : i])
                if n[key]:
                    p = (cells[*key, t[i]] + followers[key] * p) / (n[key] + followers[key])
            total += sign * math.log(p)
    return total / len(url.encode())


def test_url_scores_come_from_exact_counts(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(n))
    rows = [(i, f"http://{word(8)}.{['com/en/', 'example.net/de/8', 'io/'][i % 3]}{word(40)}") for i in range(900)]
    rows += [(900, None), (901, ""), (902, rows[2][1])]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    held = {r.url for r in frame.filter(F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)) == 0).collect()}
    got = {r.page: r for r in urls.judged(frame).collect()}
    rules = {"com/en/": "block", "example.net/de/8": "allow"}
    seen = {v: [u for i, u in rows if got[i].rule and rules[got[i].rule] == v and u not in held] for v in ("allow", "block")}
    for i in (0, 1, 2, 5, 8, 11, 902):
        assert got[i].score == pytest.approx(plain_url_score(rows[i][1], seen), abs=1e-6)
    assert got[900].score is None and got[901].score is None and len(got) == len(rows)


def test_scores_are_those_of_a_plain_model_fitted_on_all_labels(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    t = {i: " ".join([rng.choice(words) for _ in range(30)] + [["vile"], ["junk", "junk"], ["fine"]][i % 3]) for i in range(150)}
    t[1], t[2] = t[1] * 20_000, None  # 1: longer than all others together
    labels = [(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(120)] + [(5, 0, 1), (None, 1, 0), (500, 1, 0), (6, None, None)]
    got = {r.doc: r for r in quality.score(spark.createDataFrame(list(t.items()), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    known = [(i, 0 if x == 1 else 2 if q == 1 else 1) for i, q, x in labels if i in t and q is not None]
    slots = {i: s for i, s in zip(t, quality.features(pa.array(list(t.values()), pa.string())), strict=True)}
    w, cut = quality.fit([slots[i] for i, _ in known], np.array([g for _, g in known]))
    for i in t:
        tails = [1 / (1 + math.exp(c - w[slots[i]].sum())) for c in cut]
        assert got[i].tail == pytest.approx(tails[1], abs=1e-6) and got[i].expected_grade == pytest.approx(sum(tails), abs=1e-6) and got[i].selected == (got[i].tail >= 0.5)
    assert sum(got[i].selected == (i % 3 == 2) for i in range(3, 150)) >= 140


def test_every_source_of_a_large_mix_gets_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)  # a table of far more words than this
    rows = [(i, " ".join(["w"] * 100), "big") for i in range(300)] + [(1000, " ".join(["w"] * 9), "tiny"), (1001, " ".join(["w"] * 90), "small"), (1002, " ".join(["w"] * 495), "odd")]
    per = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"))
    for r in per.collect():
        assert abs(r.taken - r.target) <= 4, r


@pytest.mark.parametrize("total", [1, 40, 127, 128, 129, 1000, 128 * 50 + 3])
def test_slots_are_counted_as_if_they_were_made(total):
    period, golden = 128, 79
    cycles, rest = divmod(total, period)
    turns = [i * golden % period for i in range(rest)]
    last = 0
    for place in [0.0, 0.3, total / 3, total / 2, total * 0.99, float(total)]:
        got = mixing.slots_below(place, total, period, golden)
        assert got == sum((t + 0.5) / period * total < place for t in turns) + round(place / total * cycles * period) and got >= last
        last = got
    assert last == total


def test_blocks_find_their_slots():
    period, golden = 128, 79
    for lo, hi in ((0, 128), (5, 6), (17, 90), (127, 128), (40, 40)):
        hits = [i for i in range(period * 3) if lo <= i * golden % period < hi]
        rank = np.arange(len(hits)) if hits else np.arange(3)
        got = mixing.slot_of(rank, np.full(len(rank), lo), np.full(len(rank), hi), period, golden)
        assert got.tolist() == (hits or [-1] * 3)
    rng = np.random.default_rng(1)
    lo = rng.integers(0, mixing.PERIOD - 1, 50)
    hi = np.minimum(lo + rng.integers(1, mixing.PERIOD // 3, 50), mixing.PERIOD)
    rank = (rng.random(50) * (hi - lo)).astype(np.int64)
    for r, x, y, s in zip(rank.tolist(), lo.tolist(), hi.tolist(), mixing.slot_of(rank, lo, hi).tolist(), strict=True):
        below = lambda n: mixing.floor_sum(n, mixing.PERIOD, mixing.GOLDEN, mixing.PERIOD - x) - mixing.floor_sum(n, mixing.PERIOD, mixing.GOLDEN, mixing.PERIOD - y)  # noqa: B023, E731
        assert below(s) == r and below(s + 1) == r + 1


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 1, 1, 1, 1), (1000, 1)])
def test_every_prefix_of_the_schedule_keeps_the_shares(weights):
    n, total = 5_000, sum(weights)
    ends = np.floor(np.cumsum(weights) / total * mixing.PERIOD).astype(np.int64)
    order = []
    for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        rank = np.arange(round(n * weights[k] / total))
        order += [(s, k) for s in mixing.slot_of(rank, np.full(len(rank), lo), np.full(len(rank), hi)).tolist()]
    order = np.array([k for _, k in sorted(order)])
    for k, w in enumerate(weights):
        seen = np.cumsum(order == k)
        assert np.abs(seen - np.arange(1, len(order) + 1) * w / total).max() <= 4


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def near(x, cosine, rng):
    """Vectors at a cosine from those of x, in random directions."""
    off = rng.standard_normal(x.shape)
    off = unit(off - (off * x).sum(1)[:, None] * x)
    return cosine * x + np.sqrt(1 - cosine * cosine) * off


@pytest.mark.parametrize("d", [8, 16, 32, 64, 768])
@pytest.mark.parametrize("rows", [1_000, 10_000_000])
def test_pairs_at_the_threshold_share_a_key(d, rows):
    rng = np.random.default_rng(d)
    x = unit(rng.standard_normal((3_000, d)))
    bits, tables = itq.layout(rows, d=d)
    projection = itq.fit(x[:2_000], bits * tables)
    a, b = (itq.keys(v, projection, bits, x[:2_000].mean(axis=0)) for v in (x, near(x, 0.9, rng)))
    assert (a == b).any(axis=1).mean() >= 0.99
    assert (a[:, 0] == a[::-1, 0]).mean() < 0.2  # keys tell others apart


@pytest.mark.parametrize("d, mean", [(8, 0.0), (16, 0.8), (64, 0.0), (64, 0.8), (768, 0.0)])
def test_links_near_the_threshold_are_found(spark, d, mean):
    rng = np.random.default_rng(5)
    x = unit(np.sqrt(mean) * unit(np.ones(d)) + np.sqrt(1 - mean) * unit(rng.standard_normal((600, d))))
    x = np.vstack((x, near(x, rng.uniform(0.9, 0.95, (600, 1)), rng)))
    links = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.99 * links.sum() and all(got[i] <= links[i] for i in got)


@pytest.mark.parametrize(("mean", "most"), [(0.0, 0.1), (0.5, 0.2), (0.8, 0.6)])
def test_tables_compare_few_pairs_under_a_common_mean(mean, most):
    rng = np.random.default_rng(4)
    x = unit(np.sqrt(mean) * np.ones(64) / 8 + np.sqrt(1 - mean) * unit(rng.standard_normal((20_000, 64))))
    bits, tables = itq.layout(len(x), x=x)
    keys = itq.keys(x, itq.fit(x, bits * tables), bits, x.mean(axis=0))
    assert max(np.unique(k, return_counts=True)[1].max() for k in keys.T) < 2_000 and itq.compared(keys) < most
    y = near(x[:3_000], 0.9, rng)
    assert (keys[:3_000] == itq.keys(y, itq.fit(x, bits * tables), bits, x.mean(axis=0))).any(axis=1).mean() >= 0.99


def test_vectors_that_hardly_differ_are_all_compared(spark):
    rng = np.random.default_rng(6)
    x = unit(np.ones(16) + 0.02 * rng.standard_normal((300, 16)))
    x[:40] = unit(rng.standard_normal((40, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400 + i, [1.0, 0.1 * i, 0.0]) for i in range(5)] + [(500, [1.0] * 5), (501, [2.0] * 5)]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(got[i].n_links for i in range(300)) >= 0.99 * links.sum() and all(got[i].n_links <= links[i] for i in range(300))
    assert [got[400 + i].component_id for i in range(5)] == [400] * 5 and got[501].component_id == 500  # lengths apart


def test_search_of_rarer_lengths(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)] + [(100 + i, rng.standard_normal(5).tolist()) for i in range(9)] + [(200, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(e, e.filter("vec_id % 4 = 0"), "vec_id", "embedding", 3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for i, v in rows:
        if 100 <= i < 200 and i % 4 == 0:
            assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in sorted((-float(np.dot(v, w)), j) for j, w in rows if len(w) == 5 and j != i)[:3]]
    assert 200 not in got


def test_links_of_blocks_are_those_of_one_bucket(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.vstack((unit(rng.standard_normal((40, 12))), near(np.repeat(unit(rng.standard_normal((1, 12))), 200, 0), 0.97, rng))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, x[50].tolist())], "vec_id long, embedding array<float>")
    want = sorted(itq.near_duplicates(df).collect())
    monkeypatch.setattr(itq, "BLOCK", 16)
    assert sorted(itq.near_duplicates(df).collect()) == want
    u = unit(x.astype(np.float64))
    assert [r.n_links for r in want[:240]] == [(u @ u[i] >= 0.9).sum() - 1 + (u[i] @ u[50] >= 0.9) for i in range(240)]


def test_a_query_whose_parts_hold_too_few_asks_all(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "fit", lambda *a, f=ann.fit: (f(*a)[0], 1))  # one part a query
    hits = ann.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", 60).collect()
    for q in range(0, 120, 20):
        order = [i for i in np.lexsort((np.arange(120), -(x @ x[q]))).tolist() if i != q][:60]
        assert [r.vec_id for r in sorted((r for r in hits if r.query_id == q), key=lambda r: r["rank"])] == order


def test_parts_and_their_sample_grow_with_the_rows():
    assert [ann.layout(n) for n in (10, 50_000, 1_000_000, 10**9)] == [(4, 4_096), (64, 4_096), (1_024, 8_192), (4_096, 32_768)]


def test_a_long_text_has_the_counts_of_its_parts(monkeypatch):
    rng = random.Random(4)
    t = "".join(rng.choice("abcXYZéß  ,.12日") for _ in range(5_000))
    whole = [dict(zip(g.tolist(), c.tolist(), strict=True)) for g, c in langid.counted(pa.array([t, "x"]))]
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert [dict(zip(g.tolist(), c.tolist(), strict=True)) for g, c in langid.counted(pa.array([t, "x"]))] == whole
