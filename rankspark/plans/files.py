"""Sinks and readers over whole tables: each query writes a table in a format of the evaluation and reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as S
from ..sources.scratch import shared_folder
from ..streaming import ledger as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_comment END AS l_comment FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus || chr(10) || '\"' || l_returnflag AS l_comment FROM lineitem)")
def jsonl_round_trip(spark, d) -> DataFrame:
    """All line items as JSON lines, with line feeds, quotes and nulls in a text."""
    comment = F.when(F.col("l_orderkey") % 3 != 0, F.concat("l_linestatus", F.lit('\n"'), "l_returnflag"))
    rows = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", comment.alias("l_comment"))
    S.write_jsonl(rows, path := fresh(spark, "jsonl"))
    return S.read_jsonl(spark, path, rows.schema)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority || ', \"' || o_orderstatus || '\"' END AS note FROM orders")
def csv_round_trip(spark, d) -> DataFrame:
    """All orders as CSV with a header; the note has commas, quotes and nulls."""
    note = F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')))
    S.write_csv(S.table(spark, d, "orders").select("o_orderkey", note.alias("note")), path := fresh(spark, "csv"), ["o_orderkey", "note"])
    return S.read_csv(spark, path, ["o_orderkey", "note"])


@query("SELECT trim(c_name) AS value, count(*) AS n FROM customer GROUP BY 1")
def line_list_round_trip(spark, d) -> DataFrame:
    """Every customer's name on a line, blanks and empty lines between them."""
    lines = S.table(spark, d, "customer").select(F.concat(F.lit("  "), "c_name", F.lit(" \n\n")).alias("line"))
    S.write_text(lines, "line", path := fresh(spark, "lines"))
    return S.read_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_orderkey || '-' || l_linenumber AS cache_key FROM lineitem WHERE l_linenumber > 2")
def cache_round_trip(spark, d) -> DataFrame:
    """Scores of the first two lines of each order go into the cache in two appends; what a lookup of all lines then misses."""
    rows = S.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cache_key"), F.col("l_linestatus").alias("kind"), "l_linenumber", F.col("l_discount").alias("score"))
    path = fresh(spark, "cache")
    for n in (1, 2):
        S.put_cache(rows.filter(F.col("l_linenumber") == n).drop("l_linenumber"), path)
    return S.cache_misses(rows.select("cache_key"), spark.read.parquet(path))


@query("SELECT event_type || ':' || user_id AS cache_key FROM events GROUP BY 1")
def ledger_sink(spark, d) -> DataFrame:
    """All events as a stream into the append-only ledger, twice: a key stands there once."""
    rows = S.table(spark, d, "events").select(F.concat_ws(":", "event_type", "user_id").alias("cache_key"))
    source, path = fresh(spark, "arrivals"), fresh(spark, "ledger")
    for n in (0, 1):
        rows.write.mode("append").parquet(f"{source}/{n}")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{source}/*")
    stream.append_batches(arriving, path, fresh(spark, "state"), "cache_key").awaitTermination()
    return spark.read.parquet(path).select("cache_key")
