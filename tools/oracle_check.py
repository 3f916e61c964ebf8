"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

    python tools/oracle_check.py [sf_dir] [query ...]

Compares row count, column names and an order-insensitive multiset of rows
(values compared exactly). Prints one line per query and exits non-zero on
any mismatch.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = [tuple(_norm(x) for x in r) for r in rel.fetchall()]
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        order = [d_cols.index(c) for c in s_cols]
        d_rows = [tuple(r[i] for i in order) for r in d_rows]
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        cs, cd = Counter(s_rows), Counter(d_rows)
        if cs != cd:
            only_s = list((cs - cd).elements())[:3]
            only_d = list((cd - cs).elements())[:3]
            problems.append(f"values differ; spark-only {only_s} duck-only {only_d}")
    status = "OK " if not problems else "BAD"
    print(f"{status} {name}: {len(s_rows)} rows, spark {t1 - t0:.1f}s; " + "; ".join(problems),
          flush=True)
    return not problems


def main():
    from farebox.plans import ORACLE, QUERIES
    from farebox.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [n for n in QUERIES if n in ORACLE]
    spark = get_session()
    con = duck(sf_dir)
    ok = True
    for n in names:
        try:
            ok &= compare(spark, con, n, QUERIES[n], ORACLE[n], sf_dir)
        except Exception as e:  # report and continue with the next query
            ok = False
            print(f"ERR {n}: {type(e).__name__}: {str(e)[:600]}", flush=True)
    sys.exit(0 if ok else 1)


if __name__ == "__main__":
    main()
