"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text's words are its terms (terms.py). A word is the bag of its character n-grams of GRAMS characters, `<` and `>` around it,
and of itself, each hashed into one of BUCKETS slots with a vector of WIDTH numbers; the word's vector is their average, a
passage's that of its WINDOW words in a row. A softmax over two classes, linear in that vector, says how likely the passage is
toxic, and a text is scored as its worst passage, so that an insult counts as much in a long text as in a short one. A word
that comes again within WINDOW words counts once. Unseen misspellings share most of a known word's n-grams, and slots that
fewer than one in LEAST training texts has, or only one, weigh nothing.

Vectors and softmax are trained together in numpy, by Adam: a text's passages share its gradient in the proportion of
exp(their logits), classes weigh the same, and a random DROP of the slots is left out in each step, so that no word hangs on
one slot. As the softmax is linear, a slot is one number when texts are scored: that table is what tasks get.

The fit has a bound: SAMPLE texts of each class, those of the smallest hash of their id, and of a longer text blocks of BLOCK
words of the smallest hash up to WORDS words. Labels of ids that the table lacks take no place in it; labels that contradict
each other count each. Scoring reads every whole text. A text without terms, null or empty, has the softmax of a zero vector;
one such text is part of the clean class. Without labels every score is 0, with labels of one class it is that class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import terms as T

SAMPLE, WORDS, BLOCK = 1_500, 4_096, 64
GRAMS, BUCKETS, WIDTH, WINDOW = (3, 4, 5), 1 << 18, 8, 8
LEAST, STEPS, RATE, DROP, DECAY, CALM, SEED = 400, 50, 0.1, 0.5, 1e-5, 1e-5, 12
KNOWN = 1 << 18  # words whose value a task keeps; changes time only


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of every n-gram of every word and of the words themselves."""
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    at, end = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
    place, out, whose = np.arange(len(cp)), [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(cp), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(cp) - n + 1]
            h = K.mix(h * np.uint64(K.STEP) + cp[n - 1 :] + np.uint64(1))
            if n in GRAMS:
                inside = place[: len(h)] + n <= end[: len(h)]
                out.append(h[inside] % np.uint64(BUCKETS))
                whose.append(at[: len(h)][inside])
        up = K.BYTE_CODE[0] + (place - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(cp * np.uint64(K.STEP) + up))))
        ends = np.cumsum(size)
        out.append(K.mix(total[ends] - total[ends - size]) % np.uint64(BUCKETS))
        whose.append(np.arange(len(words)))
    return np.concatenate(out).astype(np.int64), np.concatenate(whose)


def word_values(words: list[str], table: np.ndarray) -> np.ndarray:
    """Each word's average over its slots."""
    if not words:
        return np.zeros(0)
    s, w = slots(words)
    return np.bincount(w, table[s], len(words)) / np.bincount(w, minlength=len(words))


def passages(bounds: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the passages of texts with words bounds[i]:bounds[i+1]: WINDOW words each, the last ones too, or all of fewer."""
    n = np.diff(bounds)
    count = np.where(n > 0, (np.maximum(n - WINDOW, 0) + stride - 1) // stride + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][text] + np.minimum(k * stride, np.maximum(n - WINDOW, 0)[text])
    return start, np.minimum(start + WINDOW, bounds[1:][text]), text


def fresh(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether the word at each place does not stand within the WINDOW - 1 words before it in its text."""
    order = np.argsort(words, kind="stable")
    near = (np.diff(words[order]) == 0) & (np.diff(order) < WINDOW)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near &= np.diff(text[order]) == 0
    out = np.ones(len(words), bool)
    out[order[1:][near]] = False
    return out


def text_logits(values: np.ndarray, bounds: np.ndarray, bias: float) -> np.ndarray:
    """The logit of each text's worst passage; that of the bias alone without words."""
    total = np.concatenate((np.zeros(1), np.cumsum(values)))
    a, b, text = passages(bounds, 1)
    out = np.full(len(bounds) - 1, -np.inf)
    np.maximum.at(out, text, (total[b] - total[a]) / np.maximum(b - a, 1))
    return np.where(np.isinf(out), 0.0, out) + bias


class Model:
    """Vectors of the slots that training texts have, and the softmax: weights WIDTH x 2, biases 2."""

    def __init__(self, seen: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.seen = seen
        self.e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (len(seen), WIDTH))
        self.w = rng.uniform(-1, 1, (WIDTH, 2))
        self.b = np.zeros(2)

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b]

    def table(self) -> tuple[np.ndarray, float]:
        """(a number for each slot, bias): the class difference that the softmax makes of each slot's vector."""
        out = np.zeros(BUCKETS, np.float32)
        out[self.seen] = self.e @ (self.w[:, 1] - self.w[:, 0])
        return out, float(self.b[1] - self.b[0])


def gradients(m: Model, grams: tuple[np.ndarray, np.ndarray, np.ndarray], words: np.ndarray, bounds: np.ndarray, new: np.ndarray, toxic: np.ndarray, keep: np.ndarray, n_words: int) -> tuple[float, list[np.ndarray]]:
    """(loss, gradients of parts()). grams: (place in m.seen, word number, 1 / slots of the word); words: word numbers of all texts in a row, new: fresh() of them; keep: a factor a slot."""
    place, word, share = grams
    v = m.w[:, 1] - m.w[:, 0]
    e = m.e * keep[:, None]
    value = np.bincount(word, (e @ v)[place] * share, n_words)
    total = np.concatenate((np.zeros(1), np.cumsum(value[words] * new)))
    a, b, text = passages(bounds, WINDOW // 2)
    each = (total[b] - total[a]) / (b - a)
    first = np.searchsorted(text, np.arange(len(bounds) - 1))
    has = np.diff(bounds) > 0
    top = np.zeros(len(bounds) - 1)
    top[has] = np.maximum.reduceat(each, first[has]) if has.any() else 0
    pull = np.exp(each - top[text])
    norm = np.bincount(text, pull, len(top))
    pull /= norm[text]
    logit = np.bincount(text, pull * each, len(top)) + m.b[1] - m.b[0]
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    loss = -(weight * np.log(np.maximum(np.where(toxic == 1, p, 1 - p), 1e-12))).sum()
    d = weight * (p - toxic)
    g = d[text] * pull / (b - a)
    step = np.bincount(a, g, len(words) + 1) - np.bincount(b, g, len(words) + 1)
    by_word = np.bincount(words, np.cumsum(step)[:-1] * new, n_words)
    by_slot = np.bincount(place, by_word[word] * share, len(m.seen))
    dv = e.T @ by_slot
    return float(loss), [(by_slot * keep)[:, None] * v + DECAY * m.e, np.stack((-dv, dv), 1), np.array([-d.sum(), d.sum()])]


def fit(words: list[str], each: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float] | float:
    """What Model.table() gives; a plain score where the labels have fewer than two classes. each: numbers of the words in a row, text i has bounds[i]:bounds[i+1]."""
    if len(np.unique(toxic)) < 2:
        return float(toxic[0]) if len(toxic) else 0.0
    bounds, toxic = np.append(bounds, bounds[-1]), np.append(toxic, 0)  # a clean text without words
    s, w = slots(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    share = 1 / np.bincount(w, minlength=len(words))[w]
    text = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    texts = np.bincount(np.unique(text * len(words) + each) % len(words), minlength=len(words)) if words else np.zeros(0)  # an upper bound for slots: texts of each of their words
    known = np.bincount(s, texts[w], BUCKETS) >= max(2, len(toxic) // LEAST)
    s, w, share = s[known[s]], w[known[s]], share[known[s]]
    seen, place = np.unique(s, return_inverse=True)
    grams, new = (place, w, share), fresh(each, bounds).astype(np.float64)
    m, rng = Model(seen), np.random.default_rng(SEED)
    first, second = [np.zeros_like(x) for x in m.parts()], [np.zeros_like(x) for x in m.parts()]
    for t in range(1, steps + 1):
        keep = (rng.random(len(seen)) >= DROP) / (1 - DROP)
        _, d = gradients(m, grams, each, bounds, new, toxic, keep, len(words))
        for x, g, f, q in zip(m.parts(), d, first, second, strict=True):
            f += 0.1 * (g - f)
            q += 0.001 * (g * g - q)
            x -= RATE * (f / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + CALM)
    return m.table()


def training_texts(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(toxic, words, each): the bounded sample's distinct words, joined by spaces, and their numbers in the order of the text."""
    rows = labels.filter(F.col(doc).isNotNull() & F.col("toxic").isNotNull()).select(F.col(doc).alias("_id"), (F.col("toxic") == 1).cast("int").alias("toxic"), F.xxhash64(F.col(doc).cast("string"), F.lit(SEED)).alias("h"))
    rows = rows.join(docs.select(F.col(doc).alias("_id")), "_id", "left_semi")
    picked = None
    for c in (0, 1):
        some = rows.filter(F.col("toxic") == c).orderBy("h", "_id").limit(SAMPLE)
        picked = some if picked is None else picked.unionByName(some)
    joined = docs.select(F.col(doc).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "_id")  # at most 2 x SAMPLE rows of three numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 2):
            data, offsets = K.buffers(b.column(2))
            h, starts, bounds = T.terms(data, offsets)
            spelt, numbers = [], []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                take = np.arange(x, y)
                if len(take) > WORDS:  # blocks of the smallest hash, in the order of the text
                    block = (take - x) // BLOCK
                    order = np.argsort(K.mix(np.arange(block[-1] + 1, dtype=np.uint64) + h[x]), kind="stable")
                    take = take[np.isin(block, order[: WORDS // BLOCK])]
                _, at, number = np.unique(h[take], return_index=True, return_inverse=True)
                by_place = np.argsort(at)
                back = np.empty_like(by_place)
                back[by_place] = np.arange(len(by_place))
                spelt.append(" ".join(T.spelled(data, offsets, starts[take[at[by_place]]])))
                numbers.append(back[number].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spelt, pa.string()), pa.array(numbers, pa.binary())], names=["toxic", "h", "words", "each"])

    found = joined.select("toxic", "h", "text").mapInArrow(run, "toxic int, h long, words string, each binary")
    return found.orderBy("h", "toxic", "words", "each").limit(2 * SAMPLE).select("toxic", "words", "each")


def learn(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float] | float:
    known: dict[str, int] = {}
    each, bounds, toxic = [np.zeros(0, np.int64)], [0], []
    for r in training_texts(docs, labels, doc, text).toLocalIterator():  # at most 2 x SAMPLE texts of WORDS words
        own = np.array([known.setdefault(w, len(known)) for w in r["words"].split(" ")] if r["words"] else [], np.int64)
        each.append(own[np.frombuffer(r["each"], "<i4")] if len(own) else own)
        bounds.append(bounds[-1] + len(each[-1]))
        toxic.append(r["toxic"])
    return fit(list(known), np.concatenate(each), np.array(bounds), np.array(toxic, np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | float, carried: list, text: str = "text") -> DataFrame:
    """The carried columns and (score, predicted) of every row of docs."""
    kept = docs.select(*carried, F.col(text).cast("string").alias("_text"))
    n = len(kept.columns) - 1
    names = [*kept.columns[:n], "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, values = np.zeros(0, np.uint64), np.zeros(0)
        for b in K.sliced(batches, n):
            if isinstance(model, float):
                p = np.full(b.num_rows, model)
            else:
                table, bias = model
                data, offsets = K.buffers(b.column(n))
                h, starts, bounds = T.terms(data, offsets)
                own, first, number = np.unique(h, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                new = np.flatnonzero(hashes[at] != own) if len(hashes) else np.arange(len(own))
                mine = values[at] if len(hashes) else np.zeros(len(own))
                new = new[np.argsort(first[new])]
                mine[new] = word_values(T.spelled(data, offsets, starts[first[new]]), table)
                p = 1 / (1 + np.exp(-np.clip(text_logits(mine[number] * fresh(number, bounds), bounds, bias), -700, 700)))
                if len(hashes) + len(new) > KNOWN:
                    hashes, values = own[:KNOWN], mine[:KNOWN]
                else:
                    hashes, values = np.concatenate((hashes, own[new])), np.concatenate((values, mine[new]))
                    order = np.argsort(hashes)
                    hashes, values = hashes[order], values[order]
            columns = [b.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=names)

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:n])
    return kept.mapInArrow(run, f"{schema}, score double, predicted int")


def held_out(doc: F.Column) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text is divisible by 5; a null id too."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(True))
