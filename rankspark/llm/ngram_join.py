"""N-gram Jaccard join by prefix trees.

1. One scan turns each text into its set of hashed word n-grams and deals (n-gram, set) out by n-gram. Equal sets have one
   key, so exact copies are one set from the first task on. A task sends an n-gram that many of its own sets hold as one
   flag, and passes those rows on by another way, so no bucket gathers a common passage.
2. A bucket keeps the n-grams that at least two sets hold and deals them out by set. In the global order, n-grams that one
   set alone holds come first and those of HOT_HERE sets or more last; a pair that links must share a prefix n-gram, so a set
   with enough n-grams of its own has no partner and goes. Links cost nothing but shared n-grams, so what is left decides them
   exactly, on 63-bit hashes.
3. Sets that share a prefix n-gram and can match by size fall into one block; blocks are components of that graph. Common
   n-grams come last, so few prefixes reach them.
4. In a block, sets go into a trie in one order, common n-grams first. Each set walks the trie with its partial overlaps;
   a subtree ends as soon as the n-grams left on either side can't reach the threshold. Subtrees whose sets are all
   connected with the walker already are passed over, so a dense group costs one walk, and no pair list exists.
   A block of more than BLOCK_SETS sets is dealt out as pairs of sub-blocks.

Null ids, null and empty texts: such a row has its own line; a null id takes part in links but names no component unless it
stands alone (then null). Rows that repeat an id are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WORDS, PERCENT = 5, 80  # the default of near-duplicate stages
FLUSH = 1_500_000  # n-grams that a task holds before it deals them out
HOT_HERE = 64  # a task's n-gram held by so many of its sets goes as a flag
BUCKET_ROWS = 1_000_000
BLOCK_SETS = 600


def prefix_length(n: np.ndarray | int, percent: int):
    """n-grams of which linked sets of size n share at least one, whatever the order."""
    return n - -(-percent * n // 100) + 1


def overlap_needed(nx: int, ny, percent: int):
    return -(-percent * (nx + ny) // (100 + percent))


def set_key(s: np.ndarray) -> int:
    """64-bit key of a set's content."""
    with np.errstate(over="ignore"):
        return int(K.mix(np.uint64((int(K.mix(s).sum(dtype=np.uint64)) ^ int(s.sum(dtype=np.uint64)) * 3) % (1 << 64)) + np.uint64(len(s))).astype(np.int64))


def text_tag(text: str) -> F.Column:
    return F.xxhash64(F.col(text).cast("string"))


def document_sets(docs: DataFrame, doc: str, text: str, n_words: int) -> DataFrame:
    """(doc, n, key, tag) of every row; key is null for an empty set, tag is a hash of the text."""
    K.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.sliced(batches, 1):
            sets = list(K.shingle_sets(b.column(1), n_words))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), b.column(2)], names=["doc", "n", "key", "tag"])

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), text_tag(text).alias("tag")).mapInArrow(run, "doc long, n long, key long, tag long")


def _pack(tok: np.ndarray, owner: np.ndarray, keys: np.ndarray, ns: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted n-grams as differences in 16-bit planes, small owner numbers and the owners' table: little is left after compression."""
    used, small = np.unique(owner, return_inverse=True)
    wide = np.uint16 if len(used) <= 65_536 else np.uint32
    head = np.array([len(tok), len(used), len(flags), np.dtype(wide).itemsize], np.int64)
    planes = np.diff(tok, prepend=np.uint64(0)).view(np.uint16).reshape(-1, 4).T
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, keys[used], ns[used], flags, planes, small.astype(wide)))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, keys, sizes, flags)."""
    n, m, f, size = np.frombuffer(raw, np.int64, 4)
    at = 32

    def take(dtype, count):
        nonlocal at
        x = np.frombuffer(raw, dtype, count, at)
        at += x.nbytes
        return x

    keys, ns, flags = take(np.int64, m), take(np.int64, m), take(np.uint64, f)
    planes = take(np.uint16, 4 * n).reshape(4, -1)
    tok = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    owner = take(np.uint16 if size == 2 else np.uint32, n)
    return tok, keys[owner], ns[owner], flags


def _rows(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary())], names=["bucket", "blob"])


def _slices(order_key: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    at = np.searchsorted(order_key, np.arange(n + 1))
    for i in np.flatnonzero(np.diff(at)):
        yield int(i), slice(int(at[i]), int(at[i + 1]))


def _by_set(tok: np.ndarray, keys: np.ndarray, ns: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Rows dealt out by set."""
    if not len(tok):
        return []
    to = (K.mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((tok, to))
    tok, keys, ns, to = tok[order], keys[order], ns[order], to[order]
    out = []
    for b, s in _slices(to, buckets):
        table, at = np.unique(keys[s], return_index=True)
        owner = np.searchsorted(table, keys[s])
        out.append((b, _pack(tok[s], owner, table, ns[s][at], np.zeros(0, np.uint64))))
    return out


def deal_ngrams(docs: DataFrame, text: str, n_words: int, buckets: int) -> DataFrame:
    """(bucket, blob): n-grams with the sets that hold them; buckets from `buckets` on hold rows known to be shared."""
    bits = np.uint64(buckets.bit_length() - 1)

    def flush(sets: dict[int, np.ndarray], turn: int) -> pa.RecordBatch:
        keys, ns = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
        tok, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(keys)), ns)
        order = np.argsort(tok)
        tok, owner = tok[order], owner[order]
        new = np.concatenate(([True], tok[1:] != tok[:-1]))
        count = np.diff(np.append(np.flatnonzero(new), len(tok)))
        hot = np.repeat(count >= HOT_HERE, count)
        flags, parts = tok[new][count >= HOT_HERE], []
        flag_to = (flags >> (np.uint64(64) - bits)).astype(np.int64)
        cold, cold_owner = tok[~hot], owner[~hot]
        to = (cold >> (np.uint64(64) - bits)).astype(np.int64)
        found = {b: s for b, s in _slices(to, buckets)}
        flagged = {b: s for b, s in _slices(flag_to, buckets)}
        for b in sorted(found.keys() | flagged.keys()):
            s, f = found.get(b, slice(0, 0)), flagged.get(b, slice(0, 0))
            parts.append((b, _pack(cold[s], cold_owner[s], keys, ns, flags[f])))
        if hot.any():
            parts.append((buckets + turn % buckets, _pack(tok[hot], owner[hot], keys, ns, np.zeros(0, np.uint64))))
        return _rows(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        turn = context.partitionId() if context else 0
        sets, held = {}, 0
        for b in K.sliced(batches, 0):
            for s in K.shingle_sets(b.column(0), n_words):
                if len(s) and (key := set_key(s)) not in sets:
                    sets[key] = s
                    held += len(s)
                if held >= FLUSH:
                    yield flush(sets, turn)
                    sets, held, turn = {}, 0, turn + 7919
        if sets:
            yield flush(sets, turn)

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, blob binary")


def shared_ngrams(dealt: DataFrame, buckets: int, set_buckets: int) -> DataFrame:
    """(bucket, blob) by set: the n-grams that at least two sets hold, renumbered so that common ones come last."""
    def run(table: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py()) for x in table.column("blob")]
        tok, keys, ns, flags = (np.concatenate([g[i] for g in got]) for i in range(4))
        del got
        common = np.ones(len(tok), bool)  # what comes by the other way is
        if table.column("bucket")[0].as_py() < buckets and len(tok):
            order = np.lexsort((keys, tok))
            tok, keys, ns = tok[order], keys[order], ns[order]
            once = np.concatenate(([True], (tok[1:] != tok[:-1]) | (keys[1:] != keys[:-1])))
            tok, keys, ns = tok[once], keys[once], ns[once]
            starts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            count = np.diff(np.append(starts, len(tok)))
            hot = np.isin(tok[starts], flags) | (count >= HOT_HERE)
            near, common = np.repeat(hot | (count > 1), count), np.repeat(hot, count)
            tok, keys, ns, common = tok[near], keys[near], ns[near], common[near]
        tok = (tok >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63))
        return pa.Table.from_batches([_rows(_by_set(tok, keys, ns, set_buckets))])

    return dealt.groupBy("bucket").applyInArrow(run, "bucket long, blob binary")


def candidate_sets(shared: DataFrame, percent: int) -> DataFrame:
    """(key, n, ngrams): sets with too few n-grams of their own to be alone; their shared n-grams, sorted."""
    def run(table: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py()) for x in table.column("blob")]
        tok, keys, ns = (np.concatenate([g[i] for g in got]) for i in range(3))
        del got
        order = np.lexsort((tok, keys))
        tok, keys, ns = tok[order], keys[order], ns[order]
        once = np.concatenate(([True], (tok[1:] != tok[:-1]) | (keys[1:] != keys[:-1])))
        tok, keys, ns = tok[once], keys[once], ns[once]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(keys))
        own = ns[starts] - (ends - starts)
        keep = np.flatnonzero(own < prefix_length(ns[starts], percent))
        return pa.Table.from_arrays([pa.array(keys[starts[keep]], pa.int64()), pa.array(ns[starts[keep]], pa.int64()), pa.array([tok[starts[i] : ends[i]].tobytes() for i in keep], pa.binary())], names=["key", "n", "ngrams"])

    return shared.groupBy("bucket").applyInArrow(run, "key long, n long, ngrams binary")


def prefix_edges(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets with a common prefix n-gram, chained by size so that every pair that could link stays connected.

    The sets of an n-gram and size step are chained to the smallest key, which is found by a partial minimum in each task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tok, keys, ns = [], [], []
            for key, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = np.frombuffer(raw, np.uint64)
                t = t[: max(0, prefix_length(n, percent) - (n - len(t)))]
                tok.append(t)
                keys.append(np.full(len(t), key, np.int64))
                ns.append(np.full(len(t), n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(ns))], names=["ngram", "key", "n"])

    rows = sets.mapInArrow(run, "ngram long, key long, n long")
    # steps of size: linked sizes differ by a factor of at most 100 / percent, so they lie in one step or in neighbours
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    rows = K.cut(rows.select("key", F.xxhash64("ngram", step).alias("cell"), F.xxhash64("ngram", step + 1).alias("next")))
    cell = rows.groupBy("cell").agg(F.min("key").alias("rep"), F.min("next").alias("next"))
    # two stars: members to their step's smallest key, and that to the next step's
    member = K.join_hot(rows.select("cell", "key"), cell.select("cell", "rep"), "cell", "key").filter("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    following = cell.select(F.col("cell").alias("next"), F.col("rep").alias("b"))
    across = cell.select("next", F.col("rep").alias("a")).join(following, "next").filter("a <> b").select("a", "b")
    return member.unionByName(across).distinct()


@dataclass
class _Trie:
    """A path-compressed trie over lexicographically sorted sets, an entry a node, parents first.

    A node's path is flat[first : last]; sets lo..hi-1 lie below it, of which `least` is the smallest size and `longest` the
    most n-grams; its children are the nodes kids..kids_end-1, and end is how many n-grams of its sets its path ends at.
    """

    flat: np.ndarray
    first: np.ndarray
    last: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray
    longest: np.ndarray
    kids: np.ndarray
    kids_end: np.ndarray


def _trie(sets: list[np.ndarray], ns: np.ndarray) -> _Trie:
    g = len(sets)
    size = np.array([len(s) for s in sets])
    base = np.concatenate(([0], np.cumsum(size)))
    common = np.zeros(g + 1, np.int64)
    for i in range(1, g):
        m = min(size[i - 1], size[i])
        differ = np.flatnonzero(sets[i - 1][:m] != sets[i][:m])
        common[i] = differ[0] if len(differ) else m
    rows, kids = [(0, g, 0)], []  # sets lo..hi-1, n-grams before the path
    ends = []
    for lo, hi, start in rows:  # grows while it is read
        end = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(size[lo])
        ends.append(end)
        kids.append(len(rows))
        if hi - lo > 1:
            cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)).tolist(), hi]
            rows += [(x, y, end) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    lo, hi, start = (np.array(x) for x in zip(*rows, strict=True))
    end, kids = np.array(ends), np.array(kids)
    least, longest = np.array([ns[x:y].min() for x, y in zip(lo, hi, strict=True)]), np.array([size[x:y].max() for x, y in zip(lo, hi, strict=True)])
    return _Trie(np.concatenate(sets), base[lo] + start, base[lo] + end, end, lo, hi, least, longest, kids, np.append(kids[1:], len(rows)))


def trie_links(keys: np.ndarray, ns: np.ndarray, sets: list[np.ndarray], percent: int, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect every pair of sets with enough overlap, as a forest: (key, key).

    across: a side (0 or 1) per set, when only pairs between the sides are wanted.
    """
    if len(sets) < 2:
        return []
    vocabulary, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(vocabulary))  # common first: sets share long paths
    coded = rank[code]
    links = []
    for group in _sub_blocks(coded, bounds, ns, len(vocabulary), percent):
        local = [np.sort(coded[bounds[i] : bounds[i + 1]]) for i in group]
        order = sorted(range(len(group)), key=lambda j: local[j].astype(">u8").tobytes())
        group, local = [group[j] for j in order], [local[j] for j in order]
        size = ns[group]
        t, held = _trie(local, size), np.zeros(len(vocabulary), np.int64)
        mark, side = np.arange(len(group)), across[group] if across is not None else None
        for x in range(len(group)):
            own, nx = local[x], int(size[x])
            held[own] = 1
            nodes, had = np.zeros(1, np.int64), np.zeros(1, np.int64)
            while len(nodes):  # one level of the trie at a time, with the overlap that each path has so far
                met = np.concatenate(([0], np.cumsum(mark == mark[x])))
                new = met[t.hi[nodes]] - met[t.lo[nodes]] < t.hi[nodes] - t.lo[nodes]
                nodes, had = nodes[new], had[new]
                length = t.last[nodes] - t.first[nodes]
                parts = np.concatenate(([0], np.cumsum(length)))
                seen = np.concatenate(([0], np.cumsum(held[t.flat[np.arange(parts[-1]) + np.repeat(t.first[nodes] - parts[:-1], length)]])))
                have = had + seen[parts[1:]] - seen[parts[:-1]]
                need = overlap_needed(nx, t.least[nodes], percent)
                inner = t.hi[nodes] - t.lo[nodes] > 1
                left = len(own) - np.searchsorted(own, np.where(t.end[nodes] > 0, t.flat[t.last[nodes] - 1], -1), "right")
                go = inner & (have + np.minimum(left, t.longest[nodes] - t.end[nodes]) >= need)
                for y in t.lo[nodes[~inner & (have >= need)]].tolist():
                    if mark[y] != mark[x] and (side is None or side[x] != side[y]):
                        links.append((int(keys[group[x]]), int(keys[group[y]])))
                        mark[mark == mark[y]] = mark[x]
                many = (t.kids_end - t.kids)[nodes[go]]
                ends = np.concatenate(([0], np.cumsum(many)))
                nodes, had = np.arange(ends[-1]) + np.repeat(t.kids[nodes[go]] - ends[:-1], many), np.repeat(have[go], many)
            held[own] = 0
    return links


def _sub_blocks(coded: np.ndarray, bounds: np.ndarray, ns: np.ndarray, n_codes: int, percent: int) -> list[list[int]]:
    """The block split again by the prefix rule, now with exact counts: rare n-grams first."""
    rows, owner = [], []
    for i in range(len(ns)):
        s = np.sort(coded[bounds[i] : bounds[i + 1]])[::-1]  # highest rank = rarest
        keep = max(0, int(prefix_length(int(ns[i]), percent)) - (int(ns[i]) - len(s)))
        rows.append(s[:keep])
        owner.append(np.full(len(rows[-1]), i))
    tok, who = np.concatenate(rows), np.concatenate(owner)
    order = np.lexsort((ns[who], tok))
    tok, who = tok[order], who[order]
    near = (tok[1:] == tok[:-1]) & (100 * ns[who[:-1]] >= percent * ns[who[1:]])
    up = np.arange(len(ns))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    pairs = np.unique(np.stack([who[:-1][near], who[1:][near]], 1), axis=0) if near.any() else np.zeros((0, 2), int)
    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(len(ns)):
        groups.setdefault(find(i), []).append(i)
    return [g for g in groups.values() if len(g) > 1]


def block_links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of all blocks. A block of more than BLOCK_SETS sets becomes pairs of sub-blocks."""
    member = sets.join(blocks.withColumnsRenamed({"id": "key", "component": "block"}), "key")
    size = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("c")).select(F.col("component").alias("block"), F.ceil(F.col("c") / BLOCK_SETS).cast("int").alias("parts"))
    member = member.join(size, "block").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = member.select("block", "key", "n", "ngrams", "part", other).select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "key", "n", "ngrams", F.when(F.col("part") == F.col("other"), 0).otherwise(F.when(F.col("part") < F.col("other"), 0).otherwise(1)).alias("side"))

    def run(table: pa.Table) -> pa.Table:
        keys, ns = table.column("key").to_numpy(), table.column("n").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("ngrams")]
        order = np.argsort(keys)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        found = trie_links(keys[order], ns[order], [sets[i] for i in order], percent, None if within else table.column("side").to_numpy()[order])
        return pa.Table.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return dealt.groupBy("block", "i", "j").applyInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, doc: str, text: str, n_words: int, percent: int) -> DataFrame:
    """(doc, n, key, tag, group, name) of every row: the group's key and its smallest id; both null for an empty set."""
    rows = K.cut(document_sets(docs, doc, text, n_words))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(6, int(total // BUCKET_ROWS).bit_length())
    dealt = deal_ngrams(docs, text, n_words, buckets)
    sets = K.cut(candidate_sets(shared_ngrams(dealt, buckets, buckets), percent))
    blocks = K.cut(K.components(prefix_edges(sets, percent)))
    found = K.cut(block_links(sets, blocks, percent))
    K.drop_cut(sets, blocks)
    links = K.components(found)
    K.drop_cut(found)
    per_key = rows.filter("key is not null").groupBy("key").agg(F.min("doc").alias("least"))
    labelled = K.cut(per_key.join(links.withColumnRenamed("id", "key"), "key", "left").withColumn("group", F.coalesce("component", "key")))
    names = labelled.groupBy("group").agg(F.min("least").alias("name"))
    return rows.join(labelled.join(names, "group").select("key", "group", "name"), "key", "left")


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc, n, component): every row's set size and the smallest id reachable by links of Jaccard >= percent / 100.

    Documents with an empty set are alone. All rows and whole texts are compared; counts are exact on 63-bit n-gram hashes.
    """
    out = _grouped(docs, doc, text, n_words, percent)
    return out.select("doc", "n", F.when(F.col("key").isNull(), F.col("doc")).otherwise(F.col("name")).alias("component"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of one document of each group: that of the smallest id; if this id has several texts in the group, the one
    with the fewest n-grams, then of the smallest hash.

    Rows that repeat an id and a text are one document. Rows with a null id and documents with an empty set stay. Extra
    columns pass through.
    """
    groups = _grouped(docs, doc, text, n_words, percent).filter("doc is not null")
    best = groups.filter("doc = name").groupBy("group").agg(F.min("doc").alias("doc"), F.min(F.struct("n", "tag"))["tag"].alias("tag"))
    keep = best.select("doc", "tag").unionByName(groups.filter("key is null").select("doc", "tag")).distinct()
    inner = docs.toDF(*[f"in{i}" for i in range(len(docs.columns))])  # no name of docs can clash
    d, t = (f"in{docs.columns.index(c)}" for c in (doc, text))
    tagged = inner.withColumns({"doc": F.col(d).cast("long"), "tag": text_tag(t)})
    first = tagged.filter(F.col("doc").isNotNull()).join(keep, ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"])
    return first.select(*inner.columns).unionByName(inner.filter(F.col(d).isNull())).toDF(*docs.columns)
