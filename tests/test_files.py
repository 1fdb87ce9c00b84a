"""Readers and sinks on files that the tests write."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rankspark.sources import tables as S


def local(p):
    return f"file://{p}"


def test_json_documents_and_lines_come_back(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"in{i}.json").write_text(json.dumps({"id": i, "list": ["a", "é"], "none": None}, indent=2), encoding="utf-8")
    schema = "id long, list array<string>, none string"
    docs = S.read_json_documents(spark, local(f"{tmp_path}/in*.json"), schema)
    assert sorted((r.id, r.list, r.none) for r in docs.collect()) == [(0, ["a", "é"], None), (1, ["a", "é"], None)]
    S.write_jsonl(docs, local(f"{tmp_path}/out"))
    lines = sorted(line for p in (tmp_path / "out").glob("part-*") for line in p.read_text(encoding="utf-8").splitlines())
    assert lines[0] == '{"id":0,"list":["a","é"],"none":null}' and len(lines) == 2
    assert S.read_jsonl(spark, local(f"{tmp_path}/out"), schema).count() == 2
    S.write_json_document(docs.filter("id = 1"), local(f"{tmp_path}/one"))
    assert [r.id for r in S.read_json_documents(spark, local(f"{tmp_path}/one"), schema).collect()] == [1]
    with pytest.raises(ValueError):
        S.write_json_document(docs, local(f"{tmp_path}/two"))
    S.write_text(docs.filter("id = 1").select(F.col("list")[1].alias("x")), "x", local(f"{tmp_path}/text"))
    assert [p.read_text(encoding="utf-8") for p in (tmp_path / "text").glob("part-*") if p.stat().st_size] == ["é\n"]


def test_line_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\ntwo\r\none\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("\n  \n", encoding="utf-8")
    lines = S.read_lines(spark, local(f"{tmp_path}/*.txt"))
    assert [(r.position, r.value) for r in lines.orderBy("position").collect()] == [(0, "one"), (1, "two"), (2, "one")]
    files = S.file_digests(spark, local(f"{tmp_path}/*.txt")).select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"))
    bad = S.line_list_violations(lines, files).collect()
    assert sorted((r.rule, r.file[-5:], r.value) for r in bad) == [("duplicate", "a.txt", "one"), ("empty", "b.txt", None)]


def test_source_texts_and_probes(spark, tmp_path):
    (tmp_path / "good.java").write_bytes("a\r\nb\rc é\n".encode())
    (tmp_path / "bad.java").write_bytes(b"x \xff\xfe y")
    (tmp_path / "none.java").write_bytes(b"")
    texts = {r.path[-9:]: r.text for r in S.read_source_texts(spark, local(f"{tmp_path}/*.java")).collect()}
    assert texts["good.java"] == "a\nb\nc é\n" and [t for p, t in texts.items() if "bad" in p] == [None]
    probe = {r.path.split("/")[-1]: (r.readable, r.encoding_error, r.line_count) for r in S.probe_sources(spark, local(f"{tmp_path}/*.java")).collect()}
    assert probe["bad.java"] == (False, True, None) and probe["none.java"] == (True, False, 0) and probe["good.java"][:2] == (True, False)
    index = {r.path.split("/")[-1]: (r.sha256, r.bytes) for r in S.file_digests(spark, local(f"{tmp_path}/*.java")).collect()}
    assert index["bad.java"] == (hashlib.sha256(b"x \xff\xfe y").hexdigest(), 6)


def test_csv_comes_back_as_text(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1, None), ('say "x"', 2, 0.5)], "name string, n int, rate double")
    S.write_csv(df, local(f"{tmp_path}/csv"), ["rate", "name", "n"])
    got = S.read_csv(spark, local(f"{tmp_path}/csv"), ["rate", "name", "n"]).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(None, "a, b", "1"), ("0.5", 'say "x"', "2")]


def test_cache_and_paths(spark, tmp_path):
    path = local(f"{tmp_path}/cache")
    S.put_cache(spark.createDataFrame([("k1", "score", 0.5), ("k2", "embedding", 0.1)], "cache_key string, kind string, score double"), path)
    S.put_cache(spark.createDataFrame([("k3", "score", 0.7)], "cache_key string, kind string, score double"), path)
    wanted = spark.createDataFrame([("k1",), ("k4",), ("k4",), ("k3",)], "cache_key string")
    assert [r.cache_key for r in S.cache_misses(wanted, spark.read.parquet(path).filter("kind = 'score'")).collect()] == ["k4"]
    got = {r.name: r.path for r in S.artifact_paths(spark.createDataFrame([("Cli_3",)], "slug string"), "slug", "/x").collect()}
    assert got["candidates"] == "/x/data/candidates/Cli_3.json" and len(got) == len(S.ARTIFACTS)


def test_markdown_does_not_cut(spark):
    assert S.markdown_table(spark.createDataFrame([("a", None)], "m string, x int")) == "| m | x |\n|---|---|\n| a |  |\n"
    with pytest.raises(ValueError):
        S.markdown_table(spark.range(5), 4)


def test_views_are_registered(spark):
    S.register(spark, "/root/testdata/sf0.001")
    assert spark.sql("select count(*) from benchmark").first()[0] == 40


def test_example_folders_whole_damaged_and_absent(spark, tmp_path):
    folders = {"bugs_dir", "patches_dir", "tests_dir", "checkout_fixed", "checkout_buggy", "raw_exports", "representations_dir"}
    for slug in ("Cli_1", "Cli_2", "Cli_3"):
        for name, place in S.EXAMPLE_FILES.items():
            if (slug, name) in {("Cli_2", "test_labels"), ("Cli_2", "representations_dir")} or (name == "error_json" and slug != "Cli_3"):
                continue
            p = tmp_path / place.format(slug=slug)
            p = p / "deep" / "file.txt" if name in folders else p
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("x" * 3)
    examples = spark.createDataFrame([("Cli_1",), ("Cli_2",), ("Cli_3",), ("Cli_9",)], "slug string")
    found = S.example_files(spark, examples, "slug", local(f"{tmp_path}"))
    rows = {(r.slug, r.name): (r.files, r.bytes) for r in found.collect()}
    assert len(rows) == 4 * 19 and rows["Cli_1", "test_labels"] == (1, 3) and rows["Cli_2", "test_labels"] == (0, 0) and rows["Cli_1", "checkout_fixed"] == (1, 3) and rows["Cli_1", "patches_dir"] == (4, 12)
    states = {r.slug: (r.state, r.missing) for r in S.example_states(found).collect()}
    assert states["Cli_1"] == ("complete", []) and states["Cli_2"] == ("incomplete", ["representations_dir", "test_labels"]) and states["Cli_3"][0] == "error"
    assert states["Cli_9"][0] == "incomplete" and len(states["Cli_9"][1]) == 18
