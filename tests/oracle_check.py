"""Runs registered queries against their SQL and reports differences.

usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, "/root/repo")

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", round(v, 9))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", float(v))
    return ("s", str(v))


def key(row):
    return tuple((x is not None, x) if x is None or x[0] != "f" else (True, ("f", x[1])) for x in row)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: repr(key(r)))


def compare(got, want, tol=1.1e-6):
    (c1, r1), (c2, r2) = got, want
    if c1 != c2:
        return f"columns {set(c1) ^ set(c2)}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} vs {len(r2)}; got {r1[:2]} want {r2[:2]}"
    exact = sum(a == b for a, b in zip(r1, r2))
    if exact == len(r1):
        return None
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    soft = all(
        x == y or (x and y and x[0] == y[0] == "f" and abs(x[1] - y[1]) <= tol * max(1, abs(y[1])))
        for a, b in bad for x, y in zip(a, b)
    )
    a, b = bad[0]
    diff = [(c1[i], a[i], b[i]) for i in range(len(a)) if a[i] != b[i]][:4]
    return f"{'NEAR' if soft else 'DIFF'} {len(bad)}/{len(r1)} cols {c1} first {diff} row {a[:4]}"


def main(argv):
    import duckdb

    import __spark_entry__ as e
    from tests.session import make_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark = make_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    oracle = e.oracle_sql()
    fails = 0
    for name, fn in e.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            rows = df.collect()
            t1 = time.time()
            if name not in oracle:
                print(f"ROWS {name} {len(rows)} {t1 - t0:.1f}s {df.columns}", flush=True)
                continue
            cur = con.execute(oracle[name])
            cols = [d[0] for d in cur.description]
            types = [str(d[1]) for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            huge = [c for c, t in zip(cols, types) if "HUGE" in t or "DECIMAL" in t]
            res = compare(table(df.columns, rows), table(cols, want))
            nulls = [c for i, c in enumerate(df.columns) if rows and all(r[i] is None for r in rows)]
            note = (f" HUGE {huge}" if huge else "") + (f" ALLNULL {nulls}" if nulls else "")
            print(f"{'ok  ' if res is None else 'FAIL'} {name} {len(rows)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s{note} {res or ''}", flush=True)
            fails += res is not None
        except Exception as ex:  # noqa: BLE001
            fails += 1
            print(f"ERR  {name} {type(ex).__name__} {str(ex)[:700]}", flush=True)
    print("fails", fails)
    return fails


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
