"""Compare registered queries with their DuckDB answers: python tests/parity.py [sf] [name ...]."""
from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from clewline.session import local_session

ROOT = "/root/testdata"


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def compare(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(rows), None
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(cols)}", len(rows), len(want)
    a, b = canonical(df.columns, rows), canonical(cols, want)
    if a == b:
        return "ok", len(rows), len(want)
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"DIFF cols={sorted(cols)}\n   spark {only_a}\n   duck  {only_b}", len(rows), len(want)


def main(argv):
    sf = argv[0] if argv else "0.01"
    folder = f"{ROOT}/sf{sf}"
    names = argv[1:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    bad = 0
    for name in names:
        t = time.time()
        try:
            status, n, m = compare(spark, con, folder, name)
        except Exception as exc:
            status, n, m = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", None, None
        bad += status not in ("ok", "rows-only")
        print(f"{name:32s} {status} spark={n} duck={m} {time.time() - t:.2f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
