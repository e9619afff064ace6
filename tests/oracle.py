"""Run registered queries next to their DuckDB oracle and compare values.

Usage: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x).__name__), str(x)) for x in r))
    return [columns[i] for i in order], out


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message, seconds of the Spark side)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return True, f"rows only: {len(got)}", took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    gc, gr = _rows(df.columns, got)
    wc, wr = _rows(cols, want)
    if gc != wc:
        return False, f"columns {gc} != {wc}", took
    kinds = {type(x).__name__ for r in wr for x in r} & {"Decimal"}
    if kinds:
        return False, f"oracle types {kinds}", took
    if len(gr) != len(wr):
        return False, f"rows {len(gr)} != {len(wr)}", took
    bad = [(g, w) for g, w in zip(gr, wr, strict=True) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(gr)} rows differ, first {gc} {bad[0]}", took
    return True, f"{len(gr)} rows", took


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = []
    for a in args or list(queries):
        names += [n for n in queries if n.startswith(a[:-1])] if a.endswith("*") else [a]
    spark, con = session(), duck(sf_dir)
    failed = []
    for n in names:
        try:
            ok, msg, took = compare(spark, con, n, queries[n], oracles.get(n), sf_dir)
        except Exception as e:
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:1200]}", 0.0
        if not ok:
            failed.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n:26s} {took:6.2f}s  {msg[:1500]}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
