"""Compare a query with its oracle SQL on the same tables, as multisets of rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.12g}")
    if isinstance(v, int):
        return v
    return str(v)


def _sorted(rows):
    return sorted(([_cell(v) for v in r] for r in rows), key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(spark, con, query, sql: str, sf_dir: str):
    """(ok, message, spark seconds, oracle seconds)"""
    t0 = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = _sorted(tuple(r) for r in df.select(*cols).collect())
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}", t1 - t0, t2 - t1
    order = [names.index(c) for c in cols]
    want = _sorted(tuple(r[i] for i in order) for r in rows)
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}", t1 - t0, t2 - t1
    for g, w in zip(got, want):
        if g != w:
            diff = [(c, str(a)[:120], str(b)[:120]) for c, a, b in zip(cols, g, w) if a != b]
            return False, f"first difference {diff} in {str(g)[:200]}", t1 - t0, t2 - t1
    return True, f"{len(got)} rows", t1 - t0, t2 - t1


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from blockloom.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name in wanted:
        try:
            ok, msg, a, b = compare(spark, con, entry.queries()[name], oracles[name], sf)
        except Exception as e:  # noqa: BLE001
            ok, msg, a, b = False, f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:20s} {a:6.2f}s {b:6.2f}s {msg}", flush=True)
    print("failed:", bad)
