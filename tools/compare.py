"""Run registered queries in Spark and their DuckDB twins; compare results.

Usage: python tools/compare.py [SF_DIR] [name ...]
Prints one line per query: rows (spark/duckdb), column match, value match.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    import duckdb
    from spindex import get_spark
    from spindex.catalog import registry
    from spindex.oracle import oracle_sql
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    reg, sql = registry(), oracle_sql()
    failures = 0
    for name in names or list(reg):
        t0 = time.time()
        try:
            df = reg[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            failures += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:24s} spark={len(rows):7d} rows  (no oracle)  {ts:.1f}s")
            continue
        try:
            res = con.sql(sql[name])
            dcols = res.columns
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            failures += 1
            continue
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(dcols, drows)
        ok = sorted(cols) == sorted(dcols) and len(rows) == len(drows) and h1 == h2
        failures += not ok
        print(f"{name:24s} spark={len(rows):7d} duck={len(drows):7d} cols={'ok' if sorted(cols)==sorted(dcols) else 'DIFF'} "
              f"values={'MATCH' if h1 == h2 else 'DIFF'}  {ts:.1f}s")
        if not ok:
            if sorted(cols) != sorted(dcols):
                print("   spark cols", cols, "\n   duck cols ", dcols)
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(s2 - s1)[:3]:
                print("   duck only: ", x[:300])
    print("FAILURES", failures)


if __name__ == "__main__":
    main()
