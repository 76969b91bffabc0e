"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__ if not isinstance(x, (int, float)) else "n"), x if x is not None else 0) if not isinstance(x, tuple) else (False, "t", str(x)) for x in row)


def compare(spark, con, folder, name, query, sql):
    """An empty string if query and SQL agree, else what differs; plus both times."""
    t0 = time.time()
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "" if got else "no rows", t1 - t0, 0.0
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = [tuple(_norm(r[names.index(c)]) for c in cols) if sorted(names) == cols else r for r in res.fetchall()]
    t2 = time.time()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", t1 - t0, t2 - t1
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", t1 - t0, t2 - t1
    got.sort(key=_key), want.sort(key=_key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    kinds = {(c, type(g).__name__, type(w).__name__) for g0, w0 in zip(got[:50], want[:50]) for c, g, w in zip(cols, g0, w0) if g is not None and w is not None and type(g) is not type(w)}
    note = f" types {sorted(kinds)}" if kinds else ""
    if bad:
        return f"{len(bad)} of {len(got)} differ, e.g. {cols}: {bad[0][0]} vs {bad[0][1]}{note}", t1 - t0, t2 - t1
    return note.strip(), t1 - t0, t2 - t1


def main():
    import sys

    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = open_tables(folder)
    con.execute("set timezone='UTC'")
    sqls, failed = e.oracle_sql(), 0
    for name, q in e.queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            why, a, b = compare(spark, con, folder, name, q, sqls.get(name))
        except Exception as err:  # noqa: BLE001
            why, a, b = "ERROR " + str(err)[:1500], 0, 0
        failed += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name:32s} {a:6.2f}s {b:6.2f}s {'' if name in sqls else '(rows only)'} {why}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
