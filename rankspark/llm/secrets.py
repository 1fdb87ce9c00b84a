"""Secret spans: fixed patterns plus sliding-window entropy over candidate strings.

Candidates are runs of 20 or more characters of [A-Za-z0-9+/_=-]. A run belongs to the narrowest class that holds all its
characters (hex, alnum, base64); a window of 20 characters slides over it, its Shannon entropy kept by counts that change by
one character in and one out. Windows above the class's threshold merge into a span. The allow list suppresses runs that look
random but are known not to be secret. Whole texts are read; null and empty texts give no span; a row is judged by itself.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

# The base patterns and their order.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")

WINDOW = 20
THRESHOLDS = {"hex": 3.1, "alnum": 3.8, "base64": 3.9}  # bits a character in a window
ALLOW = (
    r"[A-Za-z]+", r"[a-z]+(?:[-_/][a-z]+)+", r"[A-Za-z]+(?:[-_/=+][A-Za-z]+)*", r"[0-9]+", r"[-_=+/]+",  # words, paths, numbers, rules
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r".*EXAMPLE.*", r".*example.*",
)

_LOG = [0.0] + [c * math.log2(c) for c in range(1, 256)]
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def character_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if re.fullmatch(r"[A-Za-z0-9]+", s) else "base64"


def entropy_spans(s: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Merged spans of windows whose entropy reaches the class's threshold."""
    least = thresholds[character_class(s)]
    if len(s) < window:
        return []
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c
    out: list[list[int]] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i >= window:
            gone = s[i - window]
            n = counts[gone]
            total += _LOG[n - 1] - _LOG[n]
            counts[gone] = n - 1
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([start, i + 1])
    return [(a, b) for a, b in out]


def base_spans(text: str, keywords: bool = True, runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns: leftmost, not overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST] if keywords else []
    if runs:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out)


def all_spans(text: str, allow: re.Pattern, keywords: bool = True, runs: bool = True) -> tuple[list, list]:
    """(base spans, base and entropy spans). An entropy span within a base span adds nothing and is left out."""
    base = base_spans(text, keywords, runs)
    starts, reach, more = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max)), []
    for m in CANDIDATE.finditer(text) if runs else ():
        if not allow.fullmatch(m[0]):
            for a, b in entropy_spans(m[0]):
                a, b = a + m.start(), b + m.start()
                k = bisect_right(starts, a)
                if not k or reach[k - 1] < b:
                    more.append((a, 3, b))
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc, spans array<struct<kind,start,end>>, n_assign, n_access, n_hex, base): spans in code points, end exclusive; base is the base spans written out."""
    K.small_batches(docs.sparkSession)
    pattern = "|".join(f"(?:{a})" for a in allow) or "(?!)"
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile(pattern)
        for b in K.sliced(batches, 1):
            data, offsets = K.buffers(b.column(1))
            low = K.LOWER[data].tobytes()
            inside = np.concatenate(([False], _RUN[data], [False]))
            edge = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
            edge = edge[edge[:, 1] - edge[:, 0] >= 20]  # neighbouring texts can share one; the part inside counts
            spans, base, counts = [], [], [[], [], []]
            for i in range(b.num_rows):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                keys = any(low.find(k, lo, hi) >= 0 for k in KEYWORDS)
                runs = hi - lo >= 20 and _has_run(edge, lo, hi)
                first, every = all_spans(b.column(1)[i].as_py(), allowed, keys, runs) if keys or runs else ([], [])
                spans.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in every])
                base.append(written(first))
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in first))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, struct), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string())], names=["doc", "spans", "n_assign", "n_access", "n_hex", "base"])

    kind = dict(docs.dtypes)[doc]
    schema = f"doc {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>, n_assign long, n_access long, n_hex long, base string"
    return docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _has_run(runs: np.ndarray, lo: int, hi: int) -> bool:
    """Whether 20 or more bytes of a run lie in lo..hi."""
    k = int(np.searchsorted(runs[:, 1], lo, "right"))
    while k < len(runs) and runs[k, 0] < hi:
        if min(int(runs[k, 1]), hi) - max(int(runs[k, 0]), lo) >= 20:
            return True
        k += 1
    return False


def digest(scanned: DataFrame) -> DataFrame:
    """The query's columns of scan()'s rows."""
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return scanned.select(F.col("doc").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), text.alias("spans"))
