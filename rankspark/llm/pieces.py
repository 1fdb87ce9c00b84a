"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The agenda holds candidate merges of neighbouring pieces, best score first, leftmost among equals. A candidate whose keyed
hash (seed, document, place of the word, place in the word, merged piece) falls below the dropout rate is skipped for good, so
every occurrence of a word has a segmentation of its own, all of which decode to it, and reruns agree.

Occurrences share work as far as their hashes decide alike. A node is a word and the candidates skipped so far; it holds the
merges that the agenda then makes. An occurrence starts at its word's node and goes on to the child of the first merge that
its hash skips, until it skips none. Nodes are made when first reached and kept for a task's later texts, about MOST_NODES at
most: they save time and never change a result.

No piece of the vocabulary goes on after a space or holds an unknown character, so words (spaces, then other characters)
and unknown characters are encoded apart; load() checks that. Words of a batch are encoded together, one merge each at a
time by array operations; words of more than SHORT characters without nodes, of more than LONG by a heap each. All follow the
same agenda. Texts of more than CHUNK characters are read in parts that start with a word.

Unknown characters become UTF-8 byte pieces, as does a literal U+2581, so that decoding gives back the text exactly. Null texts
have null ids; an empty text has none. A null id hashes as 0. Vocabulary files are read where the driver runs and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SEED, DROPOUT, SHORT, LONG, CHUNK, MOST_NODES = 5, 0.1, 24, 256, 1 << 20, 200_000
SPACE = "▁"
INF = np.int64(1) << np.int64(40)
ROWS = 768


@dataclass
class Vocabulary:
    pieces: list[bytes]  # what an id decodes to, spaces as spaces
    by_char: np.ndarray  # id of a character's piece, or -1
    byte_ids: np.ndarray
    pairs: np.ndarray  # left << 32 | right in the slots of a hash table with linear probing, -1 in free ones
    merged: np.ndarray  # the pair's piece, by slot
    rank: np.ndarray  # by id: place in the order of merges

    def slots(self, key: np.ndarray) -> np.ndarray:
        """Where the search for a pair starts."""
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(K.STEP)) >> np.uint64(65 - len(self.pairs).bit_length())).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each pair is there, its slot)."""
        at = self.slots(key)
        held = self.pairs[at]
        more = np.flatnonzero((held != key) & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.pairs) - 1)
            held[more] = self.pairs[at[more]]
            more = more[(held[more] != key[more]) & (held[more] >= 0)]
        return held == key, at


def load(path: str) -> Vocabulary:
    """A SentencePiece BPE model with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    ids, pieces, byte_ids = {}, [b""] * n, np.zeros(256, np.int32)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            pieces[i] = bytes([int(p[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[p] = i
            pieces[i] = p.replace(SPACE, " ").encode()
            if SPACE in p.lstrip(SPACE):
                raise ValueError("a piece goes on after a space")
    by_char = np.full(0x110000, -1, np.int32)
    for p, i in ids.items():
        if len(p) == 1 and p != SPACE:
            by_char[ord(p)] = i
    by_char[32] = ids[SPACE]
    rank = np.zeros(n, np.int64)
    rank[np.argsort([-sp.get_score(i) for i in range(n)], kind="stable")] = np.arange(n)
    pairs, merged = [], []
    for p, i in ids.items():
        for k in range(1, len(p)):
            if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None:
                pairs.append(a << 32 | b)
                merged.append(i)
        if any(c not in ids for c in p):
            raise ValueError("a piece holds an unknown character")
    size = 1 << (8 * len(pairs)).bit_length()
    v = Vocabulary(pieces, by_char, byte_ids, np.full(size, -1, np.int64), np.zeros(size, np.int32), rank)
    for key, at, piece in zip(pairs, v.slots(np.array(pairs, np.int64)).tolist(), merged, strict=True):
        while v.pairs[at] >= 0:
            at = (at + 1) % size
        v.pairs[at], v.merged[at] = key, piece
    return v


Skip = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]  # (word, place, merged piece): whether the candidate is skipped


def dropped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash skips a candidate; the key stands for seed, document and place of the word."""
    with np.errstate(over="ignore"):
        h = K.mix(key + (place.astype(np.uint64) << np.uint64(20) | piece.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(np.float64) < rate * float(1 << 53)


def _candidates(v: Vocabulary, left: np.ndarray, right: np.ndarray, word: np.ndarray, place: np.ndarray, skip: Skip | None) -> tuple[np.ndarray, np.ndarray]:
    """(rank or INF, merged piece) of neighbouring pieces."""
    key = left.astype(np.int64) << 32 | right.astype(np.int64)
    hit, at = v.find(key)
    piece = v.merged[at]
    if skip:
        some = np.flatnonzero(hit)
        hit[some] = ~skip(word[some], place[some], piece[some])
    return np.where(hit, v.rank[piece], INF), piece


def encode_long(v: Vocabulary, symbols: np.ndarray, w: int, skip: Skip | None) -> np.ndarray:
    """One word by a heap of candidate merges."""
    sym, n = symbols.astype(np.int64).tolist(), len(symbols)
    before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    r, p = _candidates(v, symbols[:-1], symbols[1:], np.full(n - 1, w), np.arange(n - 1), skip)
    agenda = [(int(r[i]), i, sym[i], sym[i + 1], int(p[i])) for i in np.flatnonzero(r < INF)]
    heapq.heapify(agenda)

    def add(i: int) -> None:
        j = after[i]
        if j >= 0:
            r, p = _candidates(v, np.array([sym[i]]), np.array([sym[j]]), np.array([w]), np.array([i]), skip)
            if r[0] < INF:
                heapq.heappush(agenda, (int(r[0]), i, sym[i], sym[j], int(p[0])))

    while agenda:
        _, i, a, b, piece = heapq.heappop(agenda)
        j = after[i] if alive[i] else -1
        if j < 0 or sym[i] != a or sym[j] != b:
            continue  # one of the two has merged meanwhile
        sym[i], alive[j], after[i] = piece, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        add(i)
        if before[i] >= 0:
            add(before[i])
    return np.array([s for s, ok in zip(sym, alive, strict=True) if ok], np.int32)


def encode_words(v: Vocabulary, symbols: np.ndarray, bounds: np.ndarray, skip: Skip | None, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of words given as character pieces; every word makes its best merge, again and again.

    trace takes (word, place, piece) arrays of the merges in their order, but for words of more than LONG characters.
    """
    n_words = len(bounds) - 1
    lengths = np.diff(bounds)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word of each id, ids)
    for w in np.flatnonzero(lengths > LONG):
        ids = encode_long(v, symbols[bounds[w] : bounds[w + 1]], int(w), skip)
        parts.append((np.full(len(ids), w), ids))
    short = np.repeat(lengths <= LONG, lengths)
    sym, word = symbols[short].astype(np.int32), np.repeat(np.arange(n_words), lengths)[short]
    place = (np.arange(len(symbols)) - np.repeat(bounds[:-1], lengths))[short]
    same = word[:-1] == word[1:]
    rank, piece = np.full(len(sym), INF), np.zeros(len(sym), np.int32)
    at = np.flatnonzero(same)
    rank[at], piece[at] = _candidates(v, sym[at], sym[at + 1], word[at], place[at], skip)
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        order = rank << 10 | place  # the best rank, leftmost; place < 2^10
        best = np.minimum.reduceat(order, starts)
        live = best < INF << 10
        count = np.diff(np.append(starts, len(sym)))
        if not live.all():
            done = np.repeat(~live, count)
            parts.append((word[done], sym[done]))
            keep = ~done
            sym, word, place, rank, piece, order = sym[keep], word[keep], place[keep], rank[keep], piece[keep], order[keep]
            best, count = best[live], count[live]
            if not len(sym):
                break
        m = np.flatnonzero(order == np.repeat(best, count))  # one in each word
        sym[m] = piece[m]
        if trace is not None:
            trace.append((word[m], place[m], piece[m]))
        keep = np.ones(len(sym), bool)
        keep[m + 1] = False
        moved = m - np.arange(len(m))  # places after the deletions
        sym, word, place, rank, piece = sym[keep], word[keep], place[keep], rank[keep], piece[keep]
        last = np.append(word[1:] != word[:-1], True)
        mark = np.zeros(len(sym), bool)
        mark[moved] = True
        mark[(moved - 1)[(moved > 0) & (word[moved - 1] == word[moved])]] = True
        rank[mark] = INF
        touched = np.flatnonzero(mark & ~last)
        rank[touched], piece[touched] = _candidates(v, sym[touched], sym[touched + 1], word[touched], place[touched], skip)
    words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    ids = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
    order = np.argsort(words, kind="stable")
    return ids[order], np.searchsorted(words[order], np.arange(n_words + 1))


def _gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of values[bounds[i]:bounds[i+1]] for i in which, and the bounds of its parts."""
    n = (bounds[1:] - bounds[:-1])[which]
    out = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[which], n)
    return values[at], out


class Nodes:
    """Words with the candidates skipped so far, the merges that follow and the pieces they end in."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.merges, self.merge_bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)  # place << 32 | piece
        self.ids, self.id_bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.parent, self.skipped = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, symbols: np.ndarray, bounds: np.ndarray, parent: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """The numbers of new nodes."""
        n, at, up, codes = len(keys), np.arange(len(keys)), parent, skipped
        banned = []
        while len(at):
            some = codes >= 0
            at, up, codes = at[some], up[some], codes[some]
            banned.append(at << 44 | (codes >> 32) << 32 | codes & 0xFFFFFFFF)  # place < 2^12
            up, codes = self.parent[up], self.skipped[up]
        ban = np.sort(np.concatenate(banned)) if banned else np.zeros(0, np.int64)

        def skip(word: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
            code = word.astype(np.int64) << 44 | place.astype(np.int64) << 32 | piece.astype(np.int64)
            return ban[np.minimum(np.searchsorted(ban, code), len(ban) - 1)] == code

        trace: list = []
        ids, id_bounds = encode_words(self.v, symbols, bounds, skip if len(ban) else None, trace)
        word = np.concatenate([t[0] for t in trace]) if trace else np.zeros(0, np.int64)
        merges = np.concatenate([t[1].astype(np.int64) << 32 | t[2] for t in trace]) if trace else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        count = np.bincount(word, minlength=n)
        out = len(self.parent) + np.arange(n)
        self.number.update(zip(keys.tolist(), out.tolist(), strict=True))
        self.merge_bounds = np.concatenate((self.merge_bounds, self.merge_bounds[-1] + np.cumsum(count)))
        self.merges = np.concatenate((self.merges, merges[order]))
        self.id_bounds = np.concatenate((self.id_bounds, self.id_bounds[-1] + id_bounds[1:]))
        self.ids = np.concatenate((self.ids, ids))
        self.parent, self.skipped = np.concatenate((self.parent, parent)), np.concatenate((self.skipped, skipped))
        return out

    def reached(self, sym: np.ndarray, start: np.ndarray, length: np.ndarray, word: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
        """The last node of every occurrence of a word: sym[start : start + length], hash of the word, key of the occurrence."""
        at, node = word.copy(), np.zeros(len(word), np.int64)
        parent, skipped = np.full(len(word), -1), np.full(len(word), -1)
        todo = np.arange(len(word))
        while len(todo):
            keys, some, which = np.unique(at[todo], return_index=True, return_inverse=True)
            found = np.fromiter((self.number.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
            new = np.flatnonzero(found < 0)
            if len(new):
                o = todo[some[new]]
                chars, bounds = _pick(sym, start[o], length[o])
                found[new] = self.add(keys[new], chars, bounds, parent[o], skipped[o])
            node[todo] = mine = found[which]
            if not rate:
                break
            merges, bounds = _gather(self.merges, self.merge_bounds, mine)
            owner = np.repeat(np.arange(len(todo)), np.diff(bounds))
            skip = np.flatnonzero(dropped(key[todo][owner], merges >> 32, merges & 0xFFFFFFFF, rate))
            who, first = np.unique(owner[skip], return_index=True)
            move, todo = merges[skip[first]], todo[who]
            parent[todo], skipped[todo] = mine[who], move
            with np.errstate(over="ignore"):
                at[todo] = K.mix(at[todo] * np.uint64(3) + move.view(np.uint64) + np.uint64(K.STEP))
        return node


def _pick(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of values[start : start + length], and the bounds of its parts."""
    out = np.concatenate(([0], np.cumsum(length)))
    return values[np.arange(out[-1]) + np.repeat(start - out[:-1], length)], out


def _encode_part(nodes: Nodes, texts: list[str], base: np.ndarray, place0: int, rate: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, bounds, words of the last text) of texts that start with a space; base: a key for each, place0: words before the first."""
    v = nodes.v
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc_bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), 0
    sym = v.by_char[cp]
    space, odd = cp == 32, sym < 0
    start = odd.copy()
    start[1:] |= (space[1:] & ~space[:-1]) | odd[:-1]
    start[doc_bounds[:-1][doc_bounds[:-1] < len(cp)]] = True
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(cp))
    length = ends - at
    up, down = K._powers(len(cp) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], dtype=np.uint64)))
        word = K.mix((total[ends] - total[at]) * down[at] + length.astype(np.uint64))
        owner = np.searchsorted(doc_bounds, at, "right") - 1
        place = np.arange(len(at)) - np.searchsorted(at, doc_bounds[:-1])[owner] + place0
        key = K.mix(base[owner] + place.astype(np.uint64))
    known = ~odd[at]
    table, first, many = [], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    held = 0

    def put(where: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        nonlocal held
        table.append(ids.astype(np.int32))
        first[where], many[where] = held + starts, counts
        held += len(ids)

    w = np.flatnonzero(known & (length <= SHORT))
    node = nodes.reached(sym, at[w], length[w], word[w], key[w], rate)
    put(w, nodes.ids, nodes.id_bounds[node], np.diff(nodes.id_bounds)[node])
    w = np.flatnonzero(known & (length > SHORT))
    if len(w):
        chars, bounds = _pick(sym, at[w], length[w])
        keys = key[w]
        ids, got = encode_words(v, chars, bounds, (lambda x, where, piece: dropped(keys[x], where, piece, rate)) if rate else None)
        put(w, ids, got[:-1], np.diff(got))
    w = np.flatnonzero(~known)
    if len(w):
        chars, which = np.unique(cp[at[w]], return_inverse=True)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
        got = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        put(w, v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], got[:-1][which], np.diff(got)[which])
    out, occurrence = _pick(np.concatenate(table), first, many)
    if len(nodes.parent) > MOST_NODES:
        nodes.clear()
    return out, occurrence[np.searchsorted(at, doc_bounds)], int((owner == len(texts) - 1).sum())


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters; all but the first start with a space that ends a run of others."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and not (text[end] == " " and text[end - 1] != " "):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def encode(v: Vocabulary, texts: list[str], docs: np.ndarray, seed: int = SEED, rate: float = DROPOUT, nodes: Nodes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of a batch of texts; docs: an unsigned number for each."""
    nodes = nodes or Nodes(v)
    with np.errstate(over="ignore"):
        base = K.mix(K.mix(docs.astype(np.uint64) + np.uint64(seed)) ^ np.uint64(K.STEP))
    ids, counts, at = [], [], 0
    while at < len(texts):
        end = at
        while end < len(texts) and len(texts[end]) <= CHUNK:
            end += 1
        if end > at:
            got, bounds, _ = _encode_part(nodes, [" " + t if t else "" for t in texts[at:end]], base[at:end], 0, rate)
            ids.append(got)
            counts += np.diff(bounds).tolist()
        if end < len(texts):
            n = words = 0
            for part in _parts(" " + texts[end]):
                got, _, more = _encode_part(nodes, [part], base[end : end + 1], words, rate)
                ids.append(got)
                n, words = n + len(got), words + more
            counts.append(n)
        at = end + 1
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))


def decode_table(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(v.pieces), np.uint8)
    return raw, np.concatenate(([0], np.cumsum([len(p) for p in v.pieces])))


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of id lists: the pieces' bytes without the first space."""
    raw, starts = decode_table(v)
    data, cuts, at = [], [np.zeros(1, np.int64)], 0
    for i in range(0, len(ids), CHUNK):
        some, parts = _gather(raw, starts, ids[i : i + CHUNK])
        data.append(some.tobytes())
        cuts.append(at + parts[1:])
        at += len(some)
    data, cuts = b"".join(data), np.concatenate(cuts)[bounds]
    return [data[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _numbers(column: pa.Array) -> np.ndarray:
    return np.array([0 if x is None else int(hashlib.blake2b(str(x).encode(), digest_size=8).hexdigest(), 16) for x in column.to_pylist()], np.uint64)


def encoded(docs: DataFrame, model: str, doc: str = "doc_id", text: str = "text", seed: int = SEED, rate: float = DROPOUT, copy: Column | None = None, ids: bool = True) -> DataFrame:
    """docs without text, plus n_pieces, pieces_sha256 (of the ids as little-endian int32), lossless, and pieces (the ids).

    copy: what tells rows of one document apart, so that each has segmentations of its own; without it they have the same.
    """
    K.small_batches(docs.sparkSession)
    v = load(model)
    names = [c for c in docs.columns if c not in (text, "n_pieces", "pieces_sha256", "lossless", "pieces")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = Nodes(v)
        for b in K.sliced(batches, 1, ROWS):
            column = b.column(1).cast(pa.large_string())
            data, offsets = K.buffers(column)
            texts = column.fill_null("").to_pylist()
            got, bounds = encode(v, texts, _numbers(b.column(0)), seed, rate, nodes)
            back = decode(v, got, bounds)
            null = np.array(column.is_null())
            n = np.diff(bounds)
            mask = pa.array(null)
            out = [*b.columns[2:], pa.array(n, mask=null), pa.array([None if z else hashlib.sha256(got[x:y].tobytes()).hexdigest() for z, x, y in zip(null, bounds[:-1], bounds[1:], strict=True)], pa.string()), pa.array([a == c for a, c in zip(texts, back, strict=True)])]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(got), mask=mask))
            yield pa.RecordBatch.from_arrays(out, names=[*names, "n_pieces", "pieces_sha256", "lossless", *["pieces"] * ids])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_pieces long, pieces_sha256 string, lossless boolean", *["pieces array<int>"] * ids])
    own = F.col(doc).cast("string") if copy is None else F.concat_ws("#", F.coalesce(F.col(doc).cast("string"), F.lit("")), copy.cast("string"))
    inner = docs.select(own.alias("in"), F.col(text).cast("string"), *names)
    return inner.toDF(*[f"in{i}" for i in range(len(inner.columns))]).mapInArrow(run, schema)  # no name of docs can clash


def decoded(rows: DataFrame, model: str, pieces: str = "pieces", text: str = "text") -> DataFrame:
    """rows without pieces, plus the decoded text; null ids give a null text."""
    v = load(model)
    names = [c for c in rows.columns if c not in (pieces, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0).to_pylist()
            bounds = np.concatenate(([0], np.cumsum([len(x or ()) for x in lists]))).astype(np.int64)
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            texts = [None if x is None else t for x, t in zip(lists, decode(v, flat, bounds), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*names, text])

    kinds = dict(rows.dtypes)
    inner = rows.select(F.col(pieces), *names)
    return inner.toDF(*[f"in{i}" for i in range(len(inner.columns))]).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{text}` string"]))
