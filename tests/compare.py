"""Runs queries against their SQL counterparts: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tidemark.session import build_session  # noqa: E402
from tidemark.sources.readers import TABLES  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=key)


def differences(spark, con, query, folder):
    """Empty when equal, else a description."""
    df = query.run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return "" if got else "no rows"
    res = con.execute(query.sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; {got[:2]} {want[:2]}"
    for a, b in zip(got, want):
        if a != b and not (a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))):
            return f"{a} against {b}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {a} against {b}"
    return ""


def main():
    from tidemark.plans import REGISTRY

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(REGISTRY)
    spark, con = build_session(), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            note = differences(spark, con, REGISTRY[name], folder)
        except Exception as exc:  # report and go on
            note = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(note)
        print(f"{'FAIL' if note else 'ok'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
