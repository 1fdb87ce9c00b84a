"""The tree of digests names exactly the rows that changed, and opens nothing else."""

import random

from pyspark.sql import functions as F

from rankspark.operators import merkle


def test_only_changed_rows_and_their_leaves(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), float(i)) for i in range(3_000)] + [(None, "null key", 0.0)]
    change, lost, new = {5, 77, 1_234}, {8, 999}, [(9_001, "n", 1.0)]
    after = [(i, "z" if i in change else a, b) for i, a, b in rows if i not in lost] + new
    rng.shuffle(after)
    schema, depth = "i long, a string, b double", 3
    for name, r, parts in (("a", rows, 3), ("b", after, 7), ("c", list(reversed(rows)), 2)):
        merkle.build(spark.createDataFrame(r, schema).repartition(parts), ["i"], ["a", "b"], f"file://{tmp_path}/{name}", depth)
    a, b, c = (f"file://{tmp_path}/{n}" for n in "abc")
    got = {r.i: r.status for r in merkle.drifted(spark, a, b, ["i"], ["a", "b"], depth).collect()}
    assert got == {**{i: "changed" for i in change}, **{i: "missing" for i in lost}, 9_001: "unexpected"}
    leaves, read = merkle.unequal_leaves(spark, a, b, depth)
    assert leaves.count() <= 6 and read <= 1 + 3 * 6 * merkle.FAN < 16**3 / 10
    same, read = merkle.unequal_leaves(spark, a, c, depth)  # the order of rows and files is nothing to it
    assert same.isEmpty() and read == 1
    assert merkle.drifted(spark, a, c, ["i"], ["a", "b"], depth).isEmpty()


def test_a_table_against_none(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("i"), F.lit("v").alias("a"))
    for name, r in (("a", rows), ("none", rows.filter("false"))):
        merkle.build(r, ["i"], ["a"], f"file://{tmp_path}/{name}", 2)
    got = merkle.drifted(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/none", ["i"], ["a"], 2).collect()
    assert len(got) == 40 and {r.status for r in got} == {"missing"}
