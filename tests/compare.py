"""Run catalog queries next to their SQL checks and report differences.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cloudtally")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    """One comparable form for both engines."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(spark, folder, fn, check) -> tuple[str | None, int]:
    """(first difference or None, number of rows)."""
    df = fn(spark, folder)
    ours_cols, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duck(folder)
    cur = con.execute(check)
    theirs_cols, theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if ours_cols != theirs_cols:
        return f"columns {ours_cols} != {theirs_cols}", len(ours)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}", len(ours)
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {ours_cols}:\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", len(ours)
    return None, len(ours)


def main() -> None:
    import __spark_entry__ as entry

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = []
    for name in args.names or queries:
        start = time.time()
        try:
            if name in checks:
                why, n = differences(spark, args.sf, queries[name], checks[name])
            else:
                why, n = None, len(queries[name](spark, args.sf).collect())
        except Exception as e:
            why, n = "".join(traceback.format_exception_only(e))[:1500], -1
        if why:
            failed.append(name)
        print(f"{'FAIL' if why else 'ok  '} {name:24s} rows={n} {time.time() - start:.1f}s {why or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
