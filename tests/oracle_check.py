"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: status, rows spark/duckdb, and the first difference.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v) if not isinstance(v, (int, bool, str)) else v


def row_hash(cols, row):
    return hashlib.sha1(repr([norm(row[c]) for c in cols]).encode()).hexdigest()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    import __spark_entry__ as E
    from kindsort.session import local_session

    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            scols = sdf.columns
            srows = [r.asDict() for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SPARK {name}: {e!r}"[:600])
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows-only  {name}: spark={len(srows)} ({ts:.1f}s)")
            continue
        try:
            rel = con.execute(sqls[name])
            dcols = [d[0] for d in rel.description]
            drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SQL  {name}: {e!r}"[:600])
            bad += 1
            continue
        cols = sorted(scols)
        if sorted(dcols) != cols:
            print(f"COLUMNS    {name}: spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        sh = sorted(row_hash(cols, r) for r in srows)
        dh = sorted(row_hash(cols, r) for r in drows)
        if sh == dh:
            print(f"OK         {name}: rows={len(srows)} ({ts:.1f}s)")
        else:
            bad += 1
            sset = {row_hash(cols, r): r for r in srows}
            dset = {row_hash(cols, r): r for r in drows}
            only_s = [sset[h] for h in sset if h not in dset][:2]
            only_d = [dset[h] for h in dset if h not in sset][:2]
            print(f"MISMATCH   {name}: spark={len(srows)} duck={len(drows)}\n   spark-only {only_s}\n   duck-only  {only_d}"[:3000])
    print(f"done, {bad} failing")


if __name__ == "__main__":
    main()
