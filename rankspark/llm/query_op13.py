"""op13: the 20 best documents for every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import maxscore

NAME = "op13_maxscore_search"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = maxscore.index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = maxscore.search(shards, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", 20)
    return found.withColumnsRenamed({"item": "item_id", "doc": "doc_id"})


TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n_all, sum(len(t))::BIGINT AS l_all FROM d WHERE len(t) > 0),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_all),
g AS (SELECT tf.rid, d.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * n_all) // l_all))) AS g FROM tf JOIN w USING (term) JOIN d ON d.rid = tf.rid CROSS JOIN s),
sc AS (SELECT item_id, rid, doc_id, sum(times * g)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 20"""
