"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def differences(spark, con, name: str, run, sql: str, sf_dir: str) -> list[str]:
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return [f"columns {cols} != {sorted(names)}"]
    pick = [names.index(c) for c in cols]
    want = Counter(tuple(r[i] for i in pick) for r in cur.fetchall())
    out = []
    if got != want:
        extra, lacking = got - want, want - got
        out.append(f"rows {sum(got.values())} vs {sum(want.values())}, {cols}")
        out += [f"  only spark: {str(r)[:300]}" for r in list(extra)[:3]]
        out += [f"  only sql:   {str(r)[:300]}" for r in list(lacking)[:3]]
    if not want:
        out.append("no rows")
    return out


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from chatweave.plans.queries import REGISTRY
    from chatweave.plans.session import local_session

    sf_dir = f"{TABLES}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    only = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, q in REGISTRY.items():
        if (only and name not in only) or q.sql is None:
            continue
        t = time.time()
        try:
            diff = differences(spark, con, name, q.run, q.sql, sf_dir)
        except Exception as e:
            diff = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'ok  '} {name} {time.time() - t:.1f}s", *diff, sep="\n  " if diff else " ", flush=True)
    print("bad:", bad)
