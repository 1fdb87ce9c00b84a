"""op5: all vectors, linked at cosine 0.9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import itq

NAME = "op5_embedding_near_dedup"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM u),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN k ON k.a = v.vec_id"""
