"""Run registered queries next to their SQL equivalents: python tests/check_queries.py SF_DIR [name ...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from scriptoria.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(repr([norm(r[i]) for i in order]) for r in rows)


def compare(spark, sf, name, con):
    t0 = time.time()
    df = entry.queries()[name](spark, sf)
    got = table(df.columns, [tuple(r.asDict(True).values()) if len(set(df.columns)) == len(df.columns) else tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(got[1]), t1 - t0, 0.0, []
    rel = con.execute(sql)
    want = table([d[0] for d in rel.description], rel.fetchall())
    t2 = time.time()
    status = "ok" if got == want else ("columns" if got[0] != want[0] else "DIFF")
    a, b = set(got[1]), set(want[1])
    return status, len(got[1]), t1 - t0, t2 - t1, [got[0], want[0], len(want[1]), sorted(a - b)[:3], sorted(b - a)[:3]]


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    for name in names or entry.queries():
        try:
            status, n, s, d, info = compare(spark, sf, name, con)
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} ERROR {str(exc)[:700]}", flush=True)
            continue
        print(f"{name:28s} {status:9s} rows={n} spark={s:.2f}s sql={d:.2f}s", flush=True)
        if status not in ("ok", "rows-only"):
            for x in info:
                print("    ", str(x)[:900], flush=True)
