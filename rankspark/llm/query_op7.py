"""op7: all documents mixed by source with weights 5, 2, 1, at most three times over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing

NAME = "op7_mix_sources"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select(out.doc.alias("doc_id"), "size", "source_size", "target", "taken")


SQL = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][(position - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM p),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, position LIMIT 1),
t AS (SELECT w.*, CASE WHEN total > 0 THEN least(cap, v.level * weight) ELSE 0 END AS target FROM w CROSS JOIN v),
c AS (SELECT *, sum(target) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS hi, greatest(1, CAST(ceil(total / {float(mixing.SLOTS)}) AS BIGINT)) AS block FROM t),
z AS (SELECT any_value(total) AS total, any_value(block) AS block FROM c),
g AS (SELECT ((i % {mixing.PERIOD}) * {mixing.GOLDEN} % {mixing.PERIOD} + 0.5::DOUBLE) / {float(mixing.PERIOD)} * total AS point FROM z, range(CAST(ceil(total / block) AS BIGINT)) r(i)),
s AS (SELECT position, count(*) AS slots FROM g JOIN c ON point >= hi - target AND point < hi GROUP BY 1),
m AS (SELECT c.*, CAST(ceil(source_size / block) AS BIGINT) AS blocks, least(coalesce(slots, 0), 3 * CAST(ceil(source_size / block) AS BIGINT)) AS used FROM c LEFT JOIN s USING (position)),
o AS (SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM d)
SELECT o.doc_id, CAST(o.size AS BIGINT) AS size, m.source_size, m.target, CAST(CASE WHEN blocks = 0 THEN 0 ELSE (used // blocks) * o.size + least(greatest((used % blocks) * block - start, 0), o.size) END AS BIGINT) AS taken
FROM o JOIN m ON o.source IS NOT DISTINCT FROM m.source"""
