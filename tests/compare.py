"""Run registered queries next to their SQL and compare the rows.

    python tests/compare.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (1, repr(v + 0.0))
    if isinstance(v, int):
        return (1, str(v))
    return (1, str(v))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, otherwise what differs."""
    df = query(spark, sf_dir)
    got = df.collect()
    ref = con.execute(sql)
    names = [d[0] for d in ref.description]
    want = ref.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        diff = [(n, p[1], q[1]) for n, p, q in zip(sorted(names), *bad[0]) if p != q]
        return f"{len(bad)} of {len(a)} rows differ; first: {diff}"
    return ""


def session(cpus: str = os.environ.get("TEST_CPUS", "8")):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("loanlens")
        .config("spark.sql.shuffle.partitions", os.environ.get("TEST_CPUS", "8")).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    spark, con = session(), oracle(args.sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for key in args.keys or list(queries):
        start = time.time()
        try:
            if key in sql:
                message = compare(spark, con, queries[key], sql[key], args.sf) or "ok"
            else:
                message = f"rows only: {len(queries[key](spark, args.sf).collect())}"
        except Exception as e:  # report and go on with the next query
            message = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += not message.startswith(("ok", "rows"))
        print(f"{key:32s} {time.time() - start:6.2f}s  {message}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
