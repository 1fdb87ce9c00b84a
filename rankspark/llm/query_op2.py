"""op2: all documents, 4-word shingles, Jaccard of at least 0.85."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ngram_join import jaccard_components

NAME = "op2_ngram_jaccard_join"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = jaccard_components(docs, n_words=4, percent=85)
    return out.withColumnsRenamed({"doc": "doc_id", "n": "n_shingles", "component": "component_id"})


WORDS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
shared AS (SELECT g FROM x GROUP BY 1 HAVING count(*) > 1),
y AS (SELECT x.* FROM x SEMI JOIN shared USING (g)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM y a JOIN y b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
ab AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT ab.b, r.root FROM r JOIN ab ON ab.a = r.id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.root AS component_id FROM n JOIN (SELECT id, min(root) AS root FROM r GROUP BY 1) c ON c.id = n.doc_id"""
