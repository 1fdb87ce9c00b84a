"""The pipeline's stages against plain versions of the same rules, on rows with nulls, repeats, long texts and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline as P
from rankspark.llm import langid, line_dedup, mixing, ngram_join, pieces
from rankspark.llm.query_op1 import MODEL

EN = "the of and that with from this have were which their would there about when house garden river people water because other".split()
DE = "der die und das mit von nicht eine wird auch sich nach werden haben durch haus garten fluss leute wasser weil andere".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        body = [prose(rng, DE if lang == "de" else EN, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4))]
        if i % 4 == 1:
            body.insert(0, f"request {rng.randrange(10**6)} served from node {rng.randrange(99)} after {rng.randrange(999)} ms of work")
        if i % 10 == 2:
            body.append("all rights reserved by the holders of this work")
        out.append([i, "\n".join(body), lang, f"s{i % 7 % 4}"])
    for i in range(120, 140):  # near copies
        t = out[i - 120][1].split(" ")
        t[-1] = f"changed{i}"
        out.append([i, " ".join(t), out[i - 120][2], "s0"])
    out += [[140, out[3][1], out[3][2], "s2"], [141, out[4][1], "de", "s1"], [142, prose(rng, EN, 30_000), None, None]]
    out += [[143, None, "en", "s0"], [144, "", "en", "s0"], [145, "12 !", None, "s1"], [None, prose(rng, EN, 30), "en", "s1"], [7, *out[7][1:]], [146, "x" * 40_000 + " " + prose(rng, EN, 50), "en", "s3"]]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in out]


def grams(text):
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    s = " " + " ".join(letters.split()) + " "
    code = [ord(c) for c in s]
    count = Counter(c for c in code if c != 32)
    count.update((a << 21) | b for a, b in zip(code, code[1:]) if (a, b) != (32, 32))
    count.update((a << 42) | (b << 21) | c for a, b, c in zip(code, code[1:], code[2:]) if b != 32)
    return count if letters.strip() else Counter()


def ranked(count):
    return sorted(count, key=lambda g: (-count[g], g))[:300]


def language_by_hand(rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    total = {}
    for i, text, lang, *_ in rows:
        if i is not None and not held(i) and lang and text is not None:
            total.setdefault(lang, Counter()).update(grams(text))
    profile = {k: {g: r for r, g in enumerate(ranked(c), 1)} for k, c in total.items()}
    out = []
    for i, text, lang, source, n in rows:
        top = ranked(grams(text or ""))
        if not top:
            continue
        d = {k: sum(min(abs(p[g] - r), 300) if g in p else 300 for r, g in enumerate(top, 1)) for k, p in profile.items()}
        best, second = sorted(d.values())[:2]
        name = min(sorted(d), key=d.get)
        score = 0.5 * (1 - best / (300 * len(top))) + 0.5 * (1 - best / second)
        if lang in (None, name) or score < P.CLEAR_SCORE:
            out.append((i, text, lang or name, source, n))
    return out


def lines_by_hand(rows):
    mask = lambda line: tuple("#" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    where = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n") if i is not None else ():
            where.setdefault(mask(line), set()).add(i)
    where.pop((), None)
    keep = {}  # the document that keeps a masked line; None: an earlier one holds its template
    for m, docs in where.items():
        leaf = [x for x in where if len(x) == len(m) and x[:3] == m[:3]]
        if len(m) < line_dedup.LEAST:
            docs = set().union(*(where[x] for x in leaf))
            if len(docs) >= line_dedup.MANY:
                keep[m] = min(docs)
        elif any(min(where[x]) < min(docs) and sum(a == b for a, b in zip(x, m)) >= line_dedup.SIMILAR * len(m) - 1e-9 for x in leaf):
            keep[m] = None
        elif len(docs) > 1:
            keep[m] = min(docs)
    out = []
    for i, text, lang, source, _ in rows:
        if i is not None and text:
            text = "\n".join(s for s in text.split("\n") if keep.get(mask(s), i) == i)
        out.append((i, text, lang, source, None if text is None else len(text)))
    return out


def near_by_hand(rows):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for k, g in enumerate(group):
        if rows[k][0] is not None and sets[k]:
            best[g] = min(best.get(g, k), k, key=lambda i: (rows[i][0], len(sets[i]), rows[i][1]))
    kept = {(rows[k][0], rows[k][1]) for k in best.values()} | {(r[0], r[1]) for k, r in enumerate(rows) if r[0] is not None and not sets[k]}
    return sorted({r for r in rows if (r[0], r[1]) in kept} | {r for r in rows if r[0] is None}, key=order)


def order(row):
    return tuple((x is None, x) for x in row)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=order)


def test_language_stage(spark, rows):
    out = got(P.identify_language(spark, frame(spark, rows), ""))
    assert out == sorted(language_by_hand(rows), key=order) and 100 < len(out) < len(rows)


def test_line_stage(spark, rows):
    out = got(P.drop_lines(spark, frame(spark, rows), ""))
    assert out == sorted(lines_by_hand(rows), key=order)
    assert sum(len(r[1] or "") for r in out) < sum(len(r[1] or "") for r in rows) and {r[0] for r in out} == {r[0] for r in rows}


def test_near_duplicate_stage(spark, rows):
    out = got(P.drop_near_duplicates(spark, frame(spark, rows), ""))
    assert out == near_by_hand(rows) and len(out) < len(rows) - 15


def test_repeated_ids_with_other_texts_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(1, a, "en", "s", 1), (5, a + " end", "en", "s", 1), (5, b, "en", "s", 1), (5, c, "en", "s", 1), (5, c + " end", "en", "s", 1), (5, c, "en", "s", 1), (6, c, "en", "s", 1)]
    out = got(P.drop_near_duplicates(spark, frame(spark, rows), ""))
    assert out == near_by_hand(rows) and [(r[0], r[1]) for r in out] == [(1, a), (5, b), (5, c)]


def mixed_by_hand(rows):
    """The texts that the mix gives, by walking through each source's stream word by word."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    plan = {r["source"]: r for r in mixing.taken(FRAME[0](rows)).collect()}
    out, h = [], lambda i: hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()
    for s in {r[3] for r in rows}:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (h(r[0]), len(words(r[1])), FRAME[1][r[1]]))
        left = sum(p["taken"] for p in FRAME[2] if p["source"] == s)
        out += [r for r in mine if not words(r[1])]
        while left > 0:
            for r in mine:
                w = words(r[1])
                if w and left > 0:
                    text = r[1] if left >= len(w) else " ".join(w[:left])
                    out.append((*r[:1], text, *r[2:4], len(text)))
                    left -= min(left, len(w))
        size = sum(len(words(r[1])) for r in mine)
        assert plan[s]["target"] <= 3 * size
    return out


FRAME = [None, None, None]


def test_mix_stage(spark, rows):
    rows = [*rows, (7, "another text under an id that repeats", "en", rows[7][3], 37)]
    FRAME[0] = lambda r: frame(spark, r)
    FRAME[1] = {r.text: r.t for r in frame(spark, rows).select("text", P.F.xxhash64("text").alias("t")).collect()}
    FRAME[2] = mixing.taken(frame(spark, rows)).collect()
    out = got(P.mix_sources(spark, frame(spark, rows), ""))
    assert out == sorted(mixed_by_hand(rows), key=order) == got(P.mix_sources(spark, frame(spark, rows[::-1]).repartition(5), ""))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for s in {r[3] for r in rows}:
        size, target = sum(words(r[1]) for r in rows if r[3] == s), next(p["target"] for p in FRAME[2] if p["source"] == s)
        assert target <= 3 * size and abs(sum(p["taken"] for p in FRAME[2] if p["source"] == s) - target) <= 3


def test_the_mix_comes_in_the_order_of_its_slots(spark):
    rows = [(i, f"a{i} " * 500, "en", f"s{i % 4}", 0) for i in range(400)]
    out = mixing.mixed_documents(frame(spark, rows), slot="slot").collect()
    slots = [r.slot for r in out]
    assert slots == sorted(slots)
    total = Counter(r.source for r in out)
    for n in range(100, len(out), 100):  # every prefix has each source in its share
        for s, c in Counter(r.source for r in out[:n]).items():
            assert abs(c - n * total[s] / len(out)) <= 12


def test_pieces_stage(spark, rows):
    out = P.encode_pieces(spark, frame(spark, rows), "")
    assert out.filter("not lossless").isEmpty()
    back = got(pieces.decoded(out.select("doc_id", "pieces"), MODEL).select("doc_id", "text"))
    assert back == sorted(((r[0], r[1]) for r in rows), key=order)


def test_run_chains_the_stages(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mix_sources", "sentencepiece"]
    kept = near_by_hand(lines_by_hand(language_by_hand(rows)))
    plan = mixing.taken(frame(spark, kept)).filter("taken > 0 or size = 0").select("doc").distinct()
    assert {r["doc_id"] for r in out.collect()} == {r["doc"] for r in plan.collect()} and out.filter("not lossless").isEmpty()


def test_copies_have_segmentations_of_their_own(spark, tmp_path):
    text = " ".join(["internationalization", "responsibilities", "counterproductive"] * 20)
    frame(spark, [(1, text, "en", "a", 0)] * 3).coalesce(1).write.parquet(f"{tmp_path}/mix")
    out = P.encode_pieces(spark, spark.read.parquet(f"{tmp_path}/mix"), "").collect()
    assert len({tuple(r.pieces) for r in out}) == 3 and all(r.lossless for r in out)


def test_a_run_leaves_only_what_its_result_reads(spark, rows, tmp_path):
    from rankspark.llm import kernels

    frame(spark, rows[:20]).write.parquet(f"{tmp_path}/documents.parquet")
    mark = kernels.cut_mark()
    P.run(spark, str(tmp_path)).collect()
    assert len(kernels.cuts_since(mark)) == 1


def test_empty_tables_go_through(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).isEmpty()


def test_languages_and_stages_with_extra_columns(spark, rows):
    clash = ["doc", "h", "key", "n", "size", "_doc", "_text", "_gone", "_kept", "_id", "_h", "_tag", "grade", "component", "part", "target", "lang_pred", "score", "title"]
    wide = frame(spark, rows[:30]).selectExpr("*", *[f"'own' AS `{c}`" for c in clash])
    for _, stage in P.STAGES:
        assert got(stage(spark, wide, "")) == got(stage(spark, wide.select(*P.COLUMNS), ""))


def test_operators_pass_extra_columns_through(spark, rows):
    clash = ["doc", "h", "key", "n", "size", "_doc", "_gone", "_kept", "_tag", "component", "part", "copies", "in_text", "_text"]
    docs = frame(spark, rows[:30])
    wide = docs.selectExpr("*", *[f"doc_id + {k} AS `{c}`" for k, c in enumerate(clash)])
    for run in (line_dedup.deduplicated, ngram_join.keep_one, mixing.mixed_documents, lambda d: pieces.encoded(d, MODEL)):
        out = run(wide).collect()
        assert out and all(r[c] == (None if r["doc_id"] is None else r["doc_id"] + k) for r in out for k, c in enumerate(clash))
        assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in run(docs).collect())


def test_held_out_follows_the_checksum(spark):
    ids = spark.range(200).select("id", langid.held_out(P.F.col("id")).alias("x")).collect()
    assert all(r.x == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in ids)
