import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankspark.llm import ann, itq, langid, line_dedup, mixing, ngram_join, pieces, quality, secrets, urls
from rankspark.llm.query_op1 import MODEL

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if i % 3 == 2:
            w = out[rng.randrange(len(out))].split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.randrange(1, 90))]
        out.append(" ".join(w))
    return [*out, "", "One two", "one TWO", out[0]]


def test_jaccard_components_against_all_pairs(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (None, "alone in the world of words")]
    got = {r.doc: (r.n, r.component) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n_words=4, percent=85).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in range(5):
        for a, b in itertools.permutations([i for i in sets if i is not None], 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_trie_connects_what_pairs_connect():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 4000, 120).astype(np.uint64)) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 4000, len(b)).astype(np.uint64), b)) for b in base for _ in range(15)]
    ns = np.array([len(s) for s in sets])
    links = ngram_join.trie_links(np.arange(len(sets)), ns, sets, 80)

    def roots(pairs):
        up = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    want = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert want and roots(links) == roots(want) and all(tuple(sorted(x)) in want for x in links)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    assert ngram_join.jaccard_components(docs).isEmpty() and line_dedup.deduplicated(docs).isEmpty() and secrets.scan(docs).isEmpty()
    assert mixing.taken(docs).isEmpty() and langid.predict(docs, "text", langid.learn(docs, "text", "lang"), [F.col("doc_id")]).isEmpty()
    assert quality.score(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).isEmpty() and pieces.encoded(docs, MODEL).isEmpty()
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert itq.near_duplicates(e).isEmpty() and ann.search(e, e, "vec_id", "embedding").isEmpty()
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).isEmpty()


def test_pieces_agree_with_the_library_and_decode():
    import sentencepiece

    v, sp = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = ["", "  a  b\n\n c ", "日本語 \U0001f600 \x00\t", "<s> </s> <0x41>", "a" * 600, "The quick brown fox", "x▁y ▁ z"]
    ids, b = pieces.encode(v, t, np.arange(len(t), dtype=np.uint64), rate=0.0)
    for i, s in enumerate(t[:-1]):
        assert ids[b[i] : b[i + 1]].tolist() == sp.encode(s)
    for rate in (0.1, 0.5, 1.0):
        ids, b = pieces.encode(v, t, np.arange(len(t), dtype=np.uint64), rate=rate)
        assert pieces.decode(v, ids, b) == t


def plain_pieces(v, text, doc, seed, rate):
    """Every occurrence of a word by itself: the best candidate that its hash doesn't skip is merged until none is left."""
    merge = dict(zip(v.pairs[v.pairs >= 0].tolist(), v.merged[v.pairs >= 0].tolist(), strict=True))
    with np.errstate(over="ignore"):
        base = pieces.K.mix(pieces.K.mix(np.uint64([doc + seed])) ^ np.uint64(pieces.K.STEP))
    out = []
    for place, word in enumerate(plain_words(v, " " + text)):
        key = pieces.K.mix(base + np.uint64(place))
        if v.by_char[ord(word[0])] < 0:
            out += [int(v.byte_ids[b]) for b in word.encode()]
            continue
        sym = [(i, int(v.by_char[ord(c)])) for i, c in enumerate(word)]
        while True:
            found = []
            for k in range(len(sym) - 1):
                piece = merge.get(sym[k][1] << 32 | sym[k + 1][1])
                if piece is not None and not (rate and pieces.dropped(key, np.array([sym[k][0]]), np.array([piece]), rate)[0]):
                    found.append((int(v.rank[piece]), k, piece))
            if not found:
                break
            _, k, piece = min(found)
            sym[k : k + 2] = [(sym[k][0], piece)]
        out += [p for _, p in sym]
    return out


def plain_words(v, text):
    """Spaces and the characters behind them; unknown characters alone."""
    out = []
    for i, c in enumerate(text):
        odd = v.by_char[ord(c)] < 0
        if i == 0 or odd or (c == " " and text[i - 1] != " ") or v.by_char[ord(text[i - 1])] < 0:
            out.append(c)
        else:
            out[-1] += c
    return out


@pytest.mark.parametrize("rate", [0.1, 0.4])
def test_dropout_follows_the_agenda_of_every_occurrence(monkeypatch, rate):
    v = pieces.load(MODEL)
    t = ["the responsibilities of the internationalization of the the the", "a" * 30 + " counterproductive  counterproductive " + "ab" * 150, "", "日本 x☃y the", "counterproductive"]
    want = [plain_pieces(v, x, i, 3, rate) if x else [] for i, x in enumerate(t)]
    for chunk in (pieces.CHUNK, 16):
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        ids, b = pieces.encode(v, t, np.arange(len(t), dtype=np.uint64), 3, rate)
        assert [ids[x:y].tolist() for x, y in zip(b[:-1], b[1:], strict=True)] == want
        assert pieces.decode(v, ids, b) == t


def test_segmentations_vary_as_they_would_without_shared_work():
    v = pieces.load(MODEL)
    ids, b = pieces.encode(v, ["internationalization"] * 200, np.arange(200, dtype=np.uint64))
    got = {tuple(ids[x:y]) for x, y in zip(b[:-1], b[1:], strict=True)}
    plain = {tuple(plain_pieces(v, "internationalization", i, pieces.SEED, pieces.DROPOUT)) for i in range(200)}
    assert got == plain and len(got) > 30


def test_secrets_against_the_patterns(spark):
    t = ['API_KEY = "abc123def456" token:abc', "AKIA" + "A1" * 9 + " " + "0f" * 13, "x " + "Zq8vT3mK9pL2xW7rB4nY" + " y", None, "", "password:token:abcdefgh", "ünï pässword=abcdefgh"]
    got = {r.doc: r for r in secrets.scan(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    for i, s in enumerate(t):
        assert got[i].base == secrets.written(secrets.base_spans(s or ""))
    assert [s.kind for s in got[2].spans] == ["entropy"] and got[0].n_assign == 1 and got[5].n_assign == 0


def plain_spans(text):
    """All spans by the rules as written: patterns, then every window of every candidate by its own entropy."""
    import math

    out = []
    for kind, pattern, group, least in ((0, secrets.ASSIGN, 2, 6), (1, secrets.ACCESS, 0, 20), (2, secrets.HEX, 0, 24)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if not any(re.fullmatch(a, m[0]) for a in secrets.ALLOW):
            least = secrets.THRESHOLDS["hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", m[0]) else "alnum" if m[0].isalnum() else "base64"]
            covered = [False] * len(m[0])
            for i in range(len(m[0]) - 19):
                w = m[0][i : i + 20]
                if -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) >= least - 1e-9:
                    covered[i : i + 20] = [True] * 20
            edges = [i for i in range(len(covered) + 1) if (covered[i] if i < len(covered) else False) != (covered[i - 1] if i else False)]
            more += [(m.start() + a, 3, m.start() + b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return sorted(out), sorted(out + [s for s in more if not any(x <= s[0] and s[2] <= y for x, _, y in out)])


def test_secret_scan_against_every_window(spark):
    rng = random.Random(12)
    chars = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz", "abcABC0123456789xyzXYZ", "aZ3+/_=-9kQ", "ab"]
    run = lambda: "".join(rng.choice(rng.choice(chars)) if rng.random() < 0.2 else rng.choice(chars[k]) for k in [rng.randrange(6)] for _ in range(rng.randrange(1, 70)))
    word = lambda: rng.choice([run, run, lambda: "AKIA" + run(), lambda: f"api_key = '{run()}'", lambda: "Secret:" + run(), lambda: "é ünï", lambda: "EXAMPLE" + run()])()
    t = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", " ".join(f"token={run()}" for _ in range(3_000))]
    got = {r.doc: r for r in secrets.scan(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    missed = 0
    for i, s in enumerate(t):
        base, every = plain_spans(s or "")
        assert got[i].base == secrets.written(base) and [(x.start, secrets.KINDS.index(x.kind), x.end) for x in got[i].spans] == every
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        missed += len(every) - len(base)
    assert missed > 50


def test_entropy_by_counts_is_the_entropy():
    import math

    s = "aZ3kP9xQ2mL7vB4nT8yR1wC6" * 2
    for a, b in secrets.entropy_spans(s):
        w = s[a : a + 20]
        assert -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) >= secrets.THRESHOLDS["alnum"] - 1e-9 and b <= len(s)


def test_itq_and_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    x[100:160] = x[:60] + 0.05 * rng.standard_normal((60, 16))
    x[200:220] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    assert sum(got[i].n_links for i in range(400)) >= 0.9 * links.sum() and all(got[i].n_links <= links[i] for i in range(400))
    assert got[210].component_id == 5 and got[900].kept and got[901].n_links == 0
    hits = ann.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5).collect()
    good = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        good += len({r.vec_id for r in hits if r.query_id == q} & set(np.lexsort((np.arange(400), -s))[:5].tolist()))
    assert good >= 0.9 * 100 and {r.query_id for r in hits} == set(range(0, 400, 20))


def test_repeated_ids_do_not_push_others_out():
    rng = np.random.default_rng(4)
    x, ids = rng.standard_normal((60, 8)), np.array([7] * 30 + list(range(100, 130)))
    q = rng.standard_normal((3, 8))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    half = [ann.block_best(np.arange(3), q, ids[a::2], x[a::2], 5) for a in (0, 1)]
    got = ann.merged(ann.merged(none, half[0], 5), half[1], 5)
    for i in range(3):
        best = {}
        for d, s in zip(ids.tolist(), (q[i] * x).sum(1).tolist(), strict=True):
            best[d] = max(s, best.get(d, s))
        assert got[1][got[0] == i].tolist() == sorted(best, key=lambda d: (-best[d], d))[:5]


def test_lines(spark):
    rows = [(1, "GET page 17 took 5 ms\nfirst words of one text alone", 7), (2, "GET page 99 took 8 ms\nother words of a second text", 7), (3, None, 7), (4, "", 7), (None, "GET page 1 took 1 ms", 7)]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, words int")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "other words of a second text" and got[2]._dropped == 1
    assert got[3].text is None and got[4].text == "" and got[None].text == rows[4][1] and got[1].words == 7


def test_mix_hits_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), None, [None, "a", "b", "c"][i % 4], 0) for i in range(800)]
    out = mixing.taken(spark.createDataFrame(rows, DOC)).toPandas()
    per = out.groupby(out.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert abs(per.target.sum() - out["size"].sum()) < 1e-6 and ((per.taken - per.target).abs() <= 0.01 * per.target + 3).all() and (out.taken <= 3 * out["size"]).all()


def test_languages(spark):
    rows = [(i, f"the house and the garden {i} are there" if i % 2 else f"das haus und der garten {i} sind dort", "en" if i % 2 else "de", "s", 0) for i in range(40)] + [(90, None, "en", "s", 0), (91, "12 !", "de", "s", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in langid.predict(docs, "text", langid.learn(docs, "text", "lang"), [F.col("doc_id")]).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40)) and got[90].lang_pred == got[91].lang_pred == "und" and got[90].score == 0


@pytest.mark.parametrize("url, host, path", [("http://A.Com/en/x?q#f", "a.com", "/en/x"), ("https://h?x=/y", "h", ""), ("no scheme", "", ""), (None, "", "")])
def test_url_parts(spark, url, host, path):
    r = spark.createDataFrame([(url,)], "u string").select(urls.host(F.col("u")).alias("h"), urls.path(F.col("u")).alias("p")).first()
    assert (r.h, r.p) == (host, path)


def test_url_rules(spark):
    rows = [(1, "http://www.example.com/en/71"), (2, "http://www.example.com/en/61"), (3, "http://notcom/en/1"), (4, "http://x.org/es/1"), (5, None)]
    got = {r.page: (r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("example.com/en/7", "allow") and got[2] == ("com/en/", "block") and got[3][0] is None and got[4][0] == "org/es/" and got[5] == (None, "allow")


def test_grades_learned():
    t = ["bad awful words here " * 3, "good fine text there " * 3, "plain junk junk junk " * 3] * 40
    w, cut = quality.fit(list(quality.features(pa.array(t))), np.array([0, 2, 1] * 40))
    z = [float(w[s].sum()) for s in quality.features(pa.array(t[:3]))]
    assert z[0] < cut[0] < z[2] < cut[1] < z[1] and (np.diff(cut) > 0).all()


def test_grades_on_texts_not_seen():
    rng = random.Random(6)
    vocab, foul = [f"w{i}" for i in range(2000)], ["vile", "nasty", "rotten"]

    def text(grade, n):
        w = [rng.choice(vocab) for _ in range(n)]
        return " ".join([*w[: n // 2], *([rng.choice(foul)] * (grade == 0)), *w[n // 2 :]]) if grade != 1 else " | ".join(w)

    seen = [(g, text(g, rng.randrange(5, 200))) for g in (0, 1, 2, 2, 2) * 200]
    w, cut = quality.fit(list(quality.features(pa.array([t for _, t in seen]))), np.array([g for g, _ in seen]))
    new = [(g, text(g, n)) for g in (0, 1, 2) * 30 for n in (20, 3000)]
    z = [float(w[s].sum()) for s in quality.features(pa.array([t for _, t in new]))]
    assert np.mean([(x >= cut[1]) == (g == 2) for x, (g, _) in zip(z, new, strict=True)]) >= 0.95


def test_the_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 40)
    r, c = np.repeat(np.arange(40), 6), rng.integers(0, 30, 240)
    weight = rng.random(40)
    w, raw = np.zeros(quality.DIM), np.array([-0.4, 0.3])
    w[:30] = rng.standard_normal(30)
    value, dw, draw = quality.loss(w, raw, r, c, grades, weight)
    plain = 0.0  # the cumulative-link likelihood by its definition
    cut = [raw[0], raw[0] + np.exp(raw[1])]
    for i in range(40):
        z = w[c[r == i]].sum()
        above = [1.0, *[1 / (1 + np.exp(t - z)) for t in cut], 0.0]
        plain -= weight[i] * np.log(above[grades[i]] - above[grades[i] + 1])
    assert value == pytest.approx(plain + quality.DECAY / 2 * (w @ w))
    for at in (0, 7, 29):
        e = np.zeros(quality.DIM)
        e[at] = 1e-6
        assert dw[at] == pytest.approx((quality.loss(w + e, raw, r, c, grades, weight)[0] - quality.loss(w - e, raw, r, c, grades, weight)[0]) / 2e-6, abs=1e-5)
    for at in (0, 1):
        e = np.eye(2)[at] * 1e-6
        assert draw[at] == pytest.approx((quality.loss(w, raw + e, r, c, grades, weight)[0] - quality.loss(w, raw - e, r, c, grades, weight)[0]) / 2e-6, abs=1e-5)


def test_slots_come_back_from_lists_and_bits():
    for slots in (np.zeros(0, np.int64), np.array([0, 5, quality.DIM - 1]), np.arange(0, quality.DIM, 3)):
        assert (quality.unpacked(quality.packed(slots)) == slots).all() and len(quality.packed(slots)) <= quality.DIM // 8


def test_word_kernel_cuts_pieces(monkeypatch):
    from rankspark.llm import kernels as K

    t = ["alpha  beta\tgamma" * 5, "", "δelta" * 40, " x "]
    data, offsets = K.buffers(pa.array(t))
    whole = K.words(data, offsets)
    monkeypatch.setattr(K, "PIECE", 16)
    small = K.words(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, small, strict=True)) and len(whole[0]) == sum(len(re.findall(r"\S+", x)) for x in t)
