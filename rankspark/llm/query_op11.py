"""op11: product codes of all vectors after two Lloyd rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lloyd

NAME = "op11_delta_lloyd"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _assigned(book: str) -> str:
    """Nearest entry of each part: the least of distance * 64 + entry."""
    return f"(SELECT rid, part, any_value(p.q) AS q, min(64 * list_sum(list_transform(list_zip(p.q, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + entry) AS best FROM p JOIN {book} c USING (part) GROUP BY 1, 2)"


def _next(book: str, assigned: str) -> str:
    return f"""(SELECT c.part, c.entry, coalesce(n.e, c.e) AS e FROM {book} c LEFT JOIN (
  SELECT part, entry, list(m ORDER BY i) AS e FROM (SELECT part, best % 64 AS entry, i, floor(sum(q[i])::DOUBLE / count(*))::BIGINT AS m FROM {assigned}, w, generate_series(1, w.n) AS g(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) n USING (part, entry))"""


SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
w AS (SELECT max(len(x)) // 16 AS n FROM v),
p AS MATERIALIZED (SELECT rid, part, x[part * w.n + 1 : part * w.n + w.n] AS q FROM v, w, generate_series(0, 15) AS g(part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, q AS e FROM p WHERE rid <= 64),
a1 AS MATERIALIZED {_assigned("c0")},
c1 AS MATERIALIZED {_next("c0", "a1")},
a2 AS MATERIALIZED {_assigned("c1")},
c2 AS MATERIALIZED {_next("c1", "a2")},
a3 AS MATERIALIZED {_assigned("c2")},
r AS (SELECT rid, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a3 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS sha FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM v JOIN r USING (rid) CROSS JOIN h"""
