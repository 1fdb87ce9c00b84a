"""Parquet tables and the file formats the evaluation reads and writes.

Every reader goes through Spark's own file sources, so any store that Spark can open will do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LABELS_SCHEMA = "example_id string, qualified_id string, visibility string, trigger_methods array<string>, positive_classes array<string>, num_trigger_methods int, num_positive_classes int, consistency struct<all_positives_in_inventory: boolean, anomalies: array<string>>, notes string, extracted_at timestamp"
LEDGER_SCHEMA = "seq long, attempt_id string, cache_key string, kind string, bug string, split string, input_tokens long, output_tokens long, latency_ms double, usd double, actual_cash_usd double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all tables, for spark.sql."""
    for name in NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def spread(df: DataFrame, least: int | None = None, key: str | None = None) -> DataFrame:
    """Over all cores where the files give fewer tasks, or where one task would get over twice its share; other inputs stay as they are.

    A row group is read by one task, whatever its size, and the other pieces of its file are then tasks without rows. Rows are
    counted by task from the files' footers. key: a column of distinct values to deal lopsided rows by, which sorts nothing.
    """
    n = least or df.sparkSession.sparkContext.defaultParallelism
    tasks = df.rdd.getNumPartitions()
    if tasks < n:
        return df.repartition(n)
    by_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("rows"))
    most, rows = by_task.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if most * n <= 2 * rows:
        return df
    tasks = n * -(-tasks // n)
    return df.repartition(tasks, key) if key else df.repartition(tasks)


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """One JSON object in one file; the committer makes the write all-or-nothing. An error unless df has one row."""
    if len(df.limit(2).collect()) != 1:
        raise ValueError("a document is one row")
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """The column's texts as lines."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Compact JSON lines with keys in alphabetical order; the committer makes the write all-or-nothing."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank lines of each file with their zero-based position: (file, position, value)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r\n?|\n")).alias("raw_position", "raw"))
    kept = whole.select("file", "raw_position", F.trim("raw").alias("value")).filter("value <> ''")
    at = Window.partitionBy("file").orderBy("raw_position")
    return kept.select("file", (F.row_number().over(at) - 1).alias("position"), "value")


def line_list_violations(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, file, value) of read_lines(): values listed twice, and files (file) that list nothing."""
    twice = lines.groupBy("file", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate").alias("rule"), "file", "value")
    empty = files.select("file").join(lines.select("file").distinct(), "file", "left_anti").select(F.lit("empty").alias("rule"), "file", F.lit(None).cast("string").alias("value"))
    return twice.unionByName(empty)


ARTIFACTS = {  # fixed values: where an example's files lie, by name
    "example": "data/bugs/{slug}/example.json", "patch": "data/patches/{slug}/patch.txt", "patch_meta": "data/patches/{slug}/meta.json", "test_inventory": "data/tests/{slug}/inventory.json", "labels": "data/tests/{slug}/labels.json",
    "tests_all": "data/tests/{slug}/raw/tests.all", "representations": "data/representations/{slug}", "candidates": "data/candidates/{slug}.json", "ranking": "results/rankings/{slug}.json", "embedding": "results/embeddings/{slug}.json",
    "random": "results/random/{slug}.json", "semantic": "results/semantic/{slug}.json",
}


def artifact_paths(examples: DataFrame, slug: str, root: str) -> DataFrame:
    """(slug, name, path): where every example's artifacts lie."""
    paths = F.array(*[F.struct(F.lit(n).alias("name"), F.replace(F.lit(f"{root}/{p}"), F.lit("{slug}"), F.col(slug)).alias("path")) for n, p in ARTIFACTS.items()])
    return examples.select(F.col(slug).alias("slug"), F.explode(paths).alias("a")).select("slug", "a.name", "a.path")


EXAMPLE_FILES = {  # fixed values: the files and folders of one example below the data root, by name
    "bugs_dir": "bugs/{slug}", "patches_dir": "patches/{slug}", "tests_dir": "tests/{slug}",
    "example_json": "bugs/{slug}/example.json", "checkout_provenance": "bugs/{slug}/checkout_provenance.json", "error_json": "bugs/{slug}/error.json",
    "checkout_fixed": "bugs/{slug}/checkouts/fixed", "checkout_buggy": "bugs/{slug}/checkouts/buggy", "raw_exports": "bugs/{slug}/raw",
    "patch_meta": "patches/{slug}/patch_meta.json", "patch_diff": "patches/{slug}/regression_patch.diff", "patch_representation": "patches/{slug}/representation.txt",
    "raw_tests_all": "tests/{slug}/raw/tests.all", "raw_tests_trigger": "tests/{slug}/raw/tests.trigger", "raw_dir_src_tests": "tests/{slug}/raw/dir.src.tests",
    "test_inventory": "tests/{slug}/inventory.json", "test_labels": "tests/{slug}/labels.json", "representations_dir": "tests/{slug}/representations", "representations_index": "tests/{slug}/representations_index.json",
}


def example_files(spark: SparkSession, examples: DataFrame, slug: str, root: str) -> DataFrame:
    """(slug, name, path, files, bytes): what lies at each of an example's places below the root; files is 0 where nothing does.

    A folder counts the files below it, at any depth. Listing is Spark's own, so any store will do, and no file is read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    inside = re.sub(r"^\w+:/+[^/]*/?" if "://" in root and not root.startswith("file:") else r"^\w+:/+", "", root).strip("/")  # without scheme and host
    parts = F.split(F.regexp_replace("path", rf"^.*?\Q{inside}\E/", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    sizes = listed.select("length", parts.alias("parts")).select("length", F.explode(above).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    places = F.array(*[F.struct(F.lit(n).alias("name"), F.replace(F.lit(p), F.lit("{slug}"), F.col(slug)).alias("place")) for n, p in EXAMPLE_FILES.items()])
    wanted = examples.select(F.col(slug).alias("slug"), F.explode(places).alias("p")).select("slug", "p.name", "p.place")
    zero = F.lit(0).cast("long")
    return wanted.join(sizes, "place", "left").select("slug", "name", F.concat(F.lit(root.rstrip("/") + "/"), "place").alias("path"), F.coalesce("files", zero).alias("files"), F.coalesce("bytes", zero).alias("bytes"))


def example_states(found: DataFrame) -> DataFrame:
    """(slug, state, missing) of example_files(): error where error.json lies there, complete with all but error.json, else incomplete."""
    needed = [n for n in EXAMPLE_FILES if n != "error_json"]
    gone = F.sort_array(F.collect_list(F.when((F.col("files") == 0) & F.col("name").isin(needed), F.col("name"))))
    per = found.groupBy("slug").agg(gone.alias("missing"), F.max((F.col("name") == "error_json") & (F.col("files") > 0)).alias("failed"))
    return per.select("slug", F.when(F.col("failed"), "error").when(F.size("missing") == 0, "complete").otherwise("incomplete").alias("state"), "missing")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files, empty ones too, which the scan itself leaves out. The list of names is the one that the scan makes on the driver anyway."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    names = [(f.replace("file:///", "file:/"),) for f in raw.inputFiles()]
    empty = spark.createDataFrame(names, "path string").join(raw.select("path"), "path", "left_anti")
    return raw.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def read_source_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) with LF line ends; text is null where the bytes aren't UTF-8."""
    raw = _files(spark, path)
    return raw.select("path", F.regexp_replace(F.expr("try_validate_utf8(cast(content as string))"), "\r\n?", "\n").alias("text"))


def probe_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, readable, encoding_error, line_count); bad files give a row, never an error."""
    raw = _files(spark, path)
    text = F.expr("try_validate_utf8(cast(content as string))")
    n = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))
    return raw.select("path", text.isNotNull().alias("readable"), text.isNull().alias("encoding_error"), F.when(text.isNotNull(), n).alias("line_count"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """The hash index of files: (path, sha256, bytes)."""
    return _files(spark, path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; callers type them."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True)


def put_cache(df: DataFrame, path: str) -> None:
    """Appends scored rows to the content-addressed cache, one directory per kind."""
    df.write.mode("append").partitionBy("kind").parquet(path)


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Distinct wanted rows without a cache entry."""
    return wanted.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti")


def json_field(column: Column, name: str, kind: str = "string") -> Column:
    return F.get_json_object(column, f"$.{name}").try_cast(kind)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table (methods x metrics) as Markdown; an error beyond `most` rows, which are no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    out = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*out, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"
