"""Text, path and window queries over documents, pages and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import audit, merkle, windows
from ..sources.scratch import shared_folder
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIZE, STRIDE = 8, 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def documents(spark, d, *columns) -> DataFrame:
    return spread(table(spark, d, "documents").select(*columns))


CAP, MARK = 600, len(T.TRUNCATION_MARKER)


@query(f"""SELECT doc_id, length(text) > {CAP} AS truncated, CAST(least(length(text), {CAP}) AS BIGINT) AS n_chars,
md5(CASE WHEN length(text) > {CAP} THEN left(text, {(CAP - MARK) // 2}) || chr(10) || '...[truncated]...' || chr(10) || right(text, {CAP - MARK - (CAP - MARK) // 2}) ELSE text END) AS text_md5 FROM documents""")
def truncate_middle(spark, d):
    cut = T.truncate_middle(F.col("text"), CAP)
    return documents(spark, d, "doc_id", "text").select("doc_id", (F.length("text") > CAP).alias("truncated"), F.length(cut).cast("long").alias("n_chars"), F.md5(cut).alias("text_md5"))


LINES = "ln AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
SPANS = f"""{LINES}, sp AS (SELECT doc_id, ls, len(ls) AS n, unnest(range(0, CAST(greatest(0, ceil((len(ls) - {SIZE}) / {STRIDE}.0)) AS BIGINT) + 1)) * {STRIDE} AS start FROM ln),
w AS (SELECT doc_id, start, least(start + {SIZE}, n) AS "end", ls[start + 1:least(start + {SIZE}, n)] AS part FROM sp),
s AS (SELECT doc_id, start, "end", len(regexp_extract_all(array_to_string(part, chr(10)), '[A-Z]')) AS score FROM w)"""


def line_spans(spark, d) -> DataFrame:
    """(doc_id, start, end, score): windows of 8 lines every 6, scored by their capital letters."""
    df = documents(spark, d, "doc_id", "text").withColumn("ls", T.lines(F.col("text")))
    w = df.withColumn("w", F.explode(windows.line_windows(F.size("ls"), SIZE, STRIDE)))
    part = F.array_join(F.slice("ls", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")), "\n")
    score = F.length(part) - F.length(F.regexp_replace(part, "[A-Z]", ""))
    return w.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"), score.cast("long").alias("score"))


@query(f'WITH {SPANS} SELECT doc_id, start, "end", score FROM s')
def line_windows(spark, d):
    return line_spans(spark, d)


@query(f"""WITH {SPANS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) AS pick FROM s)
SELECT doc_id, start, "end", score, pick, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS position FROM p WHERE pick <= 3""")
def window_top3(spark, d):
    return windows.top_windows(line_spans(spark, d), ["doc_id"], 3)


@query(f"""WITH {SPANS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) AS pick FROM s), t AS (SELECT * FROM p WHERE pick <= 3),
c AS (SELECT doc_id, greatest(start, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start)) AS start, "end" FROM t) SELECT doc_id, start, "end" FROM c WHERE start < "end" """)
def overlap_concat(spark, d):
    top = windows.top_windows(line_spans(spark, d), ["doc_id"], 3)
    return windows.without_overlap(top, ["doc_id"])


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10), y AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM x)
SELECT l_orderkey, CAST(min(l_linenumber) AS INTEGER) AS start, CAST(max(l_linenumber) + 1 AS INTEGER) AS "end" FROM y GROUP BY l_orderkey, island""")
def interval_islands(spark, d):
    kept = table(spark, d, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_linenumber").distinct()
    return windows.islands(kept, ["l_orderkey"], "l_linenumber").select("l_orderkey", "start", "end")


IDS = "(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Cli-' || c_custkey WHEN 1 THEN 'Lang_' || c_custkey WHEN 2 THEN 'Math-0' || c_custkey ELSE c_mktsegment END AS raw FROM customer)"


@query(f"""SELECT c_custkey, raw, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9]*-[1-9][0-9]*$') THEN split_part(raw, '-', 1) WHEN contains(raw, '_') THEN split_part(raw, '_', 1) END AS project,
CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9]*-[1-9][0-9]*$') THEN split_part(raw, '-', 2) WHEN contains(raw, '_') THEN split_part(raw, '_', -1) END AS bug_id FROM {IDS}""")
def id_parse(spark, d):
    c = F.col("c_custkey")
    raw = F.when(c % 4 == 0, F.concat(F.lit("Cli-"), c)).when(c % 4 == 1, F.concat(F.lit("Lang_"), c)).when(c % 4 == 2, F.concat(F.lit("Math-0"), c)).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", raw.alias("raw")).withColumn("p", T.parse_qualified_id(F.col("raw"))).select("c_custkey", "raw", "p.project", "p.bug_id")


FQCN = "'org.' || lang || '.' || source || '.C' || (doc_id % 97) || CASE WHEN doc_id % 3 = 0 THEN '$Inner' ELSE '' END"


def fqcn() -> F.Column:
    inner = F.when(F.col("doc_id") % 3 == 0, "$Inner").otherwise("")
    return F.concat(F.lit("org."), "lang", F.lit("."), "source", F.lit(".C"), (F.col("doc_id") % 97).cast("string"), inner)


@query(f"""WITH x AS (SELECT doc_id, {FQCN} AS fqcn, 'org.' || lang || '.' || source || '.C' || (doc_id % 97) AS outer_class, 'org/' || lang || '/' || source AS package_path, 'C' || (doc_id % 97) || '.java' AS file_name FROM documents)
SELECT doc_id, outer_class, replace(outer_class, '.', '/') || '.java' AS path, package_path, file_name, replace(fqcn, '$', '__') || '.json' AS json_name FROM x""")
def path_parse(spark, d):
    name = fqcn()
    return table(spark, d, "documents").select("doc_id", T.outer_class(name).alias("outer_class"), T.class_path(name).alias("path"), T.package_path(name).alias("package_path"), T.simple_file_name(name).alias("file_name"), T.representation_file(name).alias("json_name"))


TRIG = "(SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN role ELSE 'pkg.C' || conv_id || '::test' || turn END AS raw FROM conversations)"


@query(f"SELECT conv_id, turn, CASE WHEN contains(raw, '::') THEN split_part(raw, '::', 1) END AS class_id, CASE WHEN contains(raw, '::') THEN split_part(raw, '::', 2) END AS method, NOT contains(raw, '::') AS malformed FROM {TRIG}")
def trigger_parse(spark, d):
    raw = F.when(F.col("turn") % 3 == 2, F.col("role")).otherwise(F.concat(F.lit("pkg.C"), "conv_id", F.lit("::test"), "turn"))
    return table(spark, d, "conversations").withColumn("t", T.trigger_parts(raw)).select("conv_id", "turn", "t.class_id", "t.method", "t.malformed")


@query("""WITH a AS (SELECT page_id, md5(url) AS url, length(html) AS size FROM pages), b AS (SELECT page_id, CASE WHEN page_id % 97 = 3 THEN 'moved' ELSE url END AS url, CASE WHEN page_id % 89 = 5 THEN size + 1 ELSE size END AS size FROM a WHERE page_id % 101 <> 7
UNION ALL SELECT -page_id, url, size FROM a WHERE page_id % 103 = 9)
SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.page_id IS NULL OR b.page_id IS NULL OR a.url <> b.url OR a.size <> b.size""")
def drift_tree(spark, d):
    """All pages as sealed and as found: some moved, some grown, some lost, some new; told by two trees of digests."""
    sealed = table(spark, d, "pages").select("page_id", F.md5("url").alias("url"), F.length("html").alias("size"))
    i = F.col("page_id")
    found = sealed.filter(i % 101 != 7).select("page_id", F.when(i % 97 == 3, "moved").otherwise(F.col("url")).alias("url"), F.when(i % 89 == 5, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    found = found.unionByName(sealed.filter(i % 103 == 9).withColumn("page_id", -i))
    base, depth = f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}", merkle.depth_for(sealed.count())
    for name, rows in (("sealed", sealed), ("found", found)):
        merkle.build(rows, ["page_id"], ["url", "size"], f"{base}/{name}", depth)
    return merkle.drifted(spark, f"{base}/sealed", f"{base}/found", ["page_id"], ["url", "size"], depth).select("page_id", "status")


@query(f"""WITH cls AS (SELECT doc_id, lang, source, 'org/' || lang || '/' || source || '/C' || (doc_id % 97) || '.java' AS path, 'C' || (doc_id % 97) || '.java' AS name FROM documents),
files AS (SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN 'src/' ELSE '' END || path AS path, name, lang FROM cls WHERE doc_id % 5 <> 0),
byname AS (SELECT name, lang, count(*) AS n, min(path) AS path FROM files GROUP BY 1, 2)
SELECT c.doc_id, CASE WHEN f.path IS NOT NULL THEN 'direct' WHEN b.n = 1 THEN 'fallback' WHEN b.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN f.path IS NOT NULL THEN f.path WHEN b.n = 1 THEN b.path END AS source_file
FROM cls c LEFT JOIN files f USING (path) LEFT JOIN byname b ON c.name = b.name AND c.lang = b.lang""")
def source_resolution(spark, d):
    """Full path, else the file name within the class's language as package evidence, else ambiguous or missing."""
    outer = F.concat(F.lit("org."), "lang", F.lit("."), "source", F.lit(".C"), (F.col("doc_id") % 97).cast("string"))
    cls = table(spark, d, "documents").select("doc_id", "lang", T.class_path(outer).alias("path"), T.simple_file_name(outer).alias("name"))
    files = cls.filter("doc_id % 5 <> 0").select(F.concat(F.when(F.col("doc_id") % 4 == 0, "src/").otherwise(""), "path").alias("path"), "name", "lang").distinct()
    by_name = files.groupBy("name", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only"))
    j = cls.join(files.select("path", F.lit(True).alias("hit")), "path", "left").join(by_name, ["name", "lang"], "left")
    status = F.when(F.col("hit"), "direct").when(F.col("n") == 1, "fallback").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return j.select("doc_id", status.alias("status"), F.when(F.col("hit"), F.col("path")).when(F.col("n") == 1, F.col("only")).alias("source_file"))


@query("""SELECT doc_id, md5(source || chr(10) || coalesce(CASE WHEN doc_id % 3 <> 0 THEN text END, '')) AS doc_md5, md5('CLASS:' || chr(10) || source || chr(10) || chr(10) || 'SOURCE:' || chr(10) || CASE WHEN doc_id % 3 <> 0 THEN text ELSE '[source missing]' END) AS repr_md5
FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, md5(source), md5('CLASS:' || chr(10) || source || chr(10) || chr(10) || 'SOURCE:' || chr(10) || '[source missing]') FROM documents WHERE doc_id % 3 = 0""")
def compose_document(spark, d):
    body = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    return documents(spark, d, "doc_id", "source", "text").select("doc_id", F.md5(T.compose_document(F.col("source"), body)).alias("doc_md5"), F.md5(T.compose_sections(("CLASS", F.col("source")), ("SOURCE", body))).alias("repr_md5"))


MESSAGES = (
    "HTTP 400 bad request", "HTTP 429 rate limit", "HTTP 503", "http  500 Retry-After: 7.5", "HTTP Error 429", "HTTP 999 odd", "HTTP 404: gateway timed out",
    "read timed out", "Timeout while reading; Retry-After=\"12\"", "HTTP\t529 'retry-after': '3'", "HTTP/1.1 502", "ok", "HTTP 5021", "retry-after 4",
)
MSG = "(SELECT event_id, [" + ", ".join("'" + m.replace("'", "''") + "'" for m in MESSAGES) + f"][event_id % {len(MESSAGES)} + 1] AS msg FROM events)"


@query(rf"""WITH x AS (SELECT event_id, try_cast(nullif(regexp_extract(msg, '(?i)HTTP\s+([0-9]{{3}})', 1), '') AS INTEGER) AS status,
try_cast(nullif(regexp_extract(msg, '(?i)Retry-After[''"=\s:]+([0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE) AS retry_after, lower(msg) LIKE '%timed out%' OR lower(msg) LIKE '%timeout%' AS late FROM {MSG})
SELECT event_id, status, retry_after, CASE WHEN status IS NULL THEN late ELSE status IN (429, 500, 502, 503, 529) END AS retryable, greatest([1.0, 2.0, 4.0][least(event_id % 4, 2) + 1], coalesce(retry_after, 0))::DOUBLE AS backoff FROM x""")
def http_status_parse(spark, d):
    msg = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    df = table(spark, d, "events").select("event_id", msg.alias("msg"))
    m, wait = F.col("msg"), T.retry_after_seconds(F.col("msg"))
    return df.select("event_id", T.http_status(m).alias("status"), wait.alias("retry_after"), T.is_retryable(m).alias("retryable"), T.backoff_seconds(F.col("event_id") % 4, wait).alias("backoff"))


@query(r"""WITH h AS (SELECT doc_id, 'Authorization: Bearer ' || substr(md5(doc_id::VARCHAR), 1, doc_id % 16) || ' ' || text || 'Bearer ' || substr(md5(doc_id::VARCHAR), 1, doc_id % 11) AS text FROM documents),
c AS (SELECT doc_id, text, string_split(replace(text, 'password', '[REDACTED]'), 'Bearer ') AS s FROM h),
r AS (SELECT doc_id, text, array_to_string(list_transform(s, lambda x, i: CASE WHEN i > 1 AND length(split_part(x, ' ', 1)) > 8 THEN '[REDACTED]' || substr(x, length(split_part(x, ' ', 1)) + 1) ELSE x END), 'Bearer ') AS clean FROM c)
SELECT doc_id, clean <> text AS redacted, md5(clean) AS text_md5 FROM r""")
def redaction(spark, d):
    """Every document as the body of a request whose header and end hold a bearer token of 0 to 15 characters, with one known secret."""
    key = F.md5(F.col("doc_id").cast("string"))
    text = F.concat(F.lit("Authorization: Bearer "), F.substr(key, F.lit(1), F.col("doc_id") % 16), F.lit(" "), F.col("text"), F.lit("Bearer "), F.substr(key, F.lit(1), F.col("doc_id") % 11))
    sent = documents(spark, d, "doc_id", "text").select("doc_id", text.alias("text"))
    clean = T.redact(F.col("text"), ("password",))
    return sent.select("doc_id", (clean != F.col("text")).alias("redacted"), F.md5(clean).alias("text_md5"))


@query("SELECT conv_id, count(*) AS n, sha256(string_agg(turn || ':' || role, chr(10) ORDER BY turn)) AS joined, sha256(string_agg(turn || ':' || role || chr(10), '' ORDER BY turn)) AS terminated FROM conversations GROUP BY 1")
def list_digests(spark, d):
    """Digests of each conversation's list of turns, with the two terminator rules; a list is bounded by its conversation."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"]))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    return g.select("conv_id", "n", H.digest_joined(F.col("ids")).alias("joined"), H.digest_terminated(F.col("ids")).alias("terminated"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes, len(string_split(text, chr(10))) AS n_lines FROM documents")
def input_hashes(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"))


@query("""WITH a AS (SELECT page_id AS path, md5(url) AS x FROM pages WHERE page_id % 11 <> 0), b AS (SELECT page_id AS path, CASE WHEN page_id % 13 = 0 THEN 'changed' ELSE md5(url) END AS y FROM pages WHERE page_id % 7 <> 0)
SELECT CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN x = y THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM a FULL JOIN b USING (path) GROUP BY 1""")
def reproduction_compare(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.md5("url").alias("sha256"))
    after = p.filter("path % 7 <> 0").withColumn("sha256", F.when(F.col("path") % 13 == 0, "changed").otherwise(F.col("sha256")))
    return audit.compare_digests(p.filter("path % 11 <> 0"), after).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT d.doc_id, d.text IS NOT NULL AS has_text, d.n_chars = length(d.text) AS length_ok, l.doc_id IS NOT NULL AS has_label, l.quality IN (0, 1) AND l.toxic IN (0, 1) AS label_ok FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN NOT coalesce(length_ok, true) OR NOT coalesce(label_ok, true) THEN 'error' WHEN has_text AND has_label THEN 'complete' ELSE 'incomplete' END AS state,
array_to_string(list_filter([CASE WHEN NOT has_text THEN 'text' END, CASE WHEN NOT has_label THEN 'label' END], lambda x: x IS NOT NULL), ',') AS missing FROM a""")
def example_lifecycle(spark, d):
    """A document is complete with its text and its label, and in error where one of them breaks its rule."""
    docs = documents(spark, d, "doc_id", "text", "n_chars").withColumn("text", F.struct("text", "n_chars"))
    artifacts = docs.select("doc_id", F.when(F.col("text.text").isNotNull(), F.col("text")).alias("text")).join(table(spark, d, "labels").select("doc_id", F.struct("quality", "toxic").alias("label")), "doc_id", "left")
    rules = {"text": F.col("text.n_chars") == F.length("text.text"), "label": F.col("label.quality").isin(0, 1) & F.col("label.toxic").isin(0, 1)}
    return audit.lifecycle(artifacts, ["doc_id"], rules).select("doc_id", "state", F.array_join("missing", ",").alias("missing"))


@query("""WITH want AS (SELECT source, count(*) AS n, sum(CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END) AS seen, CAST(sum(n_chars) AS BIGINT) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1),
got AS (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents WHERE doc_id % 5 <> 0 AND source IS NOT NULL GROUP BY 1)
SELECT source, w.n AS expected, coalesce(g.n, 0) AS observed, CASE WHEN g.source IS NULL THEN 'missing' WHEN w.n = g.n AND w.size = g.size THEN 'same' ELSE 'changed' END AS status FROM want w LEFT JOIN got g USING (source)""")
def manifest_drift(spark, d):
    """A manifest of counts and sizes per source, against a table that lost every fifth document."""
    docs = table(spark, d, "documents").filter("source is not null").select("doc_id", "source", "n_chars")
    facts = lambda t: t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size"))
    out = audit.drift(facts(docs), facts(docs.filter("doc_id % 5 <> 0")), ["source"], ["n", "size"])
    return out.select("source", F.col("expected.n").alias("expected"), F.coalesce(F.col("observed.n"), F.lit(0)).alias("observed"), "status")


@query("""WITH a AS (SELECT page_id, md5(url) AS url, length(html) AS size FROM pages), b AS (SELECT page_id, CASE WHEN page_id % 97 = 3 THEN 'moved' ELSE url END AS url, CASE WHEN page_id % 89 = 5 THEN size + 1 ELSE size END AS size FROM a WHERE page_id % 101 <> 7
UNION ALL SELECT -page_id, url, size FROM a WHERE page_id % 103 = 9)
SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.page_id IS NULL OR b.page_id IS NULL OR a.url <> b.url OR a.size <> b.size""")
def drift_tree(spark, d):
    """All pages as sealed and as found: some moved, some grown, some lost, some new; told by two trees of digests."""
    sealed = table(spark, d, "pages").select("page_id", F.md5("url").alias("url"), F.length("html").alias("size"))
    i = F.col("page_id")
    found = sealed.filter(i % 101 != 7).select("page_id", F.when(i % 97 == 3, "moved").otherwise(F.col("url")).alias("url"), F.when(i % 89 == 5, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    found = found.unionByName(sealed.filter(i % 103 == 9).withColumn("page_id", -i))
    base, depth = f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}", merkle.depth_for(sealed.count())
    for name, rows in (("sealed", sealed), ("found", found)):
        merkle.build(rows, ["page_id"], ["url", "size"], f"{base}/{name}", depth)
    return merkle.drifted(spark, f"{base}/sealed", f"{base}/found", ["page_id"], ["url", "size"], depth).select("page_id", "status")


@query(f"""WITH cls AS (SELECT doc_id, lang, source, 'org/' || lang || '/' || source || '/C' || (doc_id % 97) || '.java' AS path, 'C' || (doc_id % 97) || '.java' AS name FROM documents),
files AS (SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN 'src/' ELSE '' END || path AS path, name, lang FROM cls WHERE doc_id % 5 <> 0),
byname AS (SELECT name, lang, count(*) AS n, min(path) AS path FROM files GROUP BY 1, 2),
r AS (SELECT CASE WHEN f.path IS NOT NULL THEN 'direct' WHEN b.n = 1 THEN 'fallback' WHEN b.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM cls c LEFT JOIN files f USING (path) LEFT JOIN byname b ON c.name = b.name AND c.lang = b.lang)
SELECT count(*) AS total, count(*) FILTER (status = 'direct') AS direct, count(*) FILTER (status = 'fallback') AS fallback, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'missing') AS missing FROM r""")
def resolution_counts(spark, d):
    return source_resolution(spark, d).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("direct", "fallback", "ambiguous", "missing")])


@query()
def compact_greedy(spark, d):
    """Every text over 240 lines long against the words of its first benchmark item by id, header and windows as lines; shorter ones whole."""
    df = documents(spark, d, "doc_id", "text")
    item = table(spark, d, "benchmark").agg(F.min_by("text", "item_id").alias("query"))
    df = df.crossJoin(F.broadcast(item)).select("doc_id", "text", T.tokenize(F.col("query")).alias("terms"))  # one row
    out = windows.compact_sources(df, "doc_id", "text", "terms")
    return out.select("doc_id", "mode", "n_lines", "windows_total", "windows_selected", "ranges", F.sha2("compact", 256).alias("sha256"))


@query()
def unified_diff(spark, d):
    """Each turn against the one before it in its conversation."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    c = c.filter("before is not null").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    return windows.unified_diff(c, "key", "before", "text")
