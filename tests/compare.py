"""Runs registered queries in Spark and their SQL in DuckDB and compares sorted rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from rankspark.sources.tables import NAMES  # noqa: E402


def oracle(sf_dir: str):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def canonical(names: list[str], rows: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(spark, con, sf_dir: str, f, sql: str) -> tuple[bool, str]:
    df = f(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = canonical(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return True, f"{len(got)} rows"
    a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return False, f"{len(got)} and {len(want)} rows; only Spark {a}; only SQL {b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    c, sql = oracle(sf), e.oracle_sql()
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            ok, why = same(s, c, sf, f, sql[name]) if name in sql else (True, f"{f(s, sf).count()} rows, no SQL")
        except Exception as x:  # noqa: BLE001
            ok, why = False, f"{type(x).__name__}: {str(x)[:600]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - t:.1f}s", why, flush=True)
