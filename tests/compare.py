"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    return str(v)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, fn, sql, folder, con):
    """Return ``(ok, rows, message)``."""
    df = fn(spark, folder)
    cols, got = rows_of(df.columns, df.collect())
    n = sum(got.values())
    if sql is None:
        return True, n, "rows only"
    cur = con.execute(sql)
    ecols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ecols:
        return False, n, f"columns {cols} != {ecols}"
    if got == want:
        return True, n, "equal"
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return False, n, f"{n} vs {sum(want.values())} rows; only spark {extra}; only sql {missing}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from aetherlog.plans import catalog
    from aetherlog.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    names = [n for n in catalog.QUERIES if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            ok, n, msg = compare(spark, catalog.QUERIES[name], catalog.ORACLE.get(name), folder, con)
        except Exception as e:  # report and go on
            ok, n, msg = False, -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {n:7d} rows {time.time() - t0:6.1f}s {'' if ok and msg == 'equal' else msg[:1500]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
