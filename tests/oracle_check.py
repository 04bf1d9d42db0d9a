"""Compare queries with their checking SQL in DuckDB.

``python tests/oracle_check.py [--sf DIR] [prefix ...]``
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) else repr(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = df.select(*[df[c] for c in cols]).collect()
    return cols, Counter(tuple(norm(v) for v in r) for r in rows)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    cols, got = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    n = sum(got.values())
    if sql is None:
        return n > 0, f"{name}: rows {n} (no sql) {t1 - t0:.1f}s"
    dcols, want = duck_rows(con, sql)
    t2 = time.time()
    ok = cols == dcols and got == want
    msg = f"{name}: {'ok' if ok else 'MISMATCH'} rows {n} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if n == 0:
        msg += "  EMPTY"
    if not ok:
        if cols != dcols:
            msg += f"\n  columns {cols} vs {dcols}"
        else:
            msg += f"\n  rows {n} vs {sum(want.values())}; only spark {list((got - want).items())[:2]}\n  only duck {list((want - got).items())[:2]}"
    return ok, msg


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as e
    from repograin.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            ok, msg = compare(spark, con, name, fn, sqls.get(name), args.sf)
        except Exception as exc:  # report and go on with the next query
            ok, msg = False, f"{name}: ERROR {str(exc)[:350]}"
        bad += not ok
        print(msg[:900], flush=True)
    print("FAILED" if bad else "PASSED", bad)


if __name__ == "__main__":
    main()
