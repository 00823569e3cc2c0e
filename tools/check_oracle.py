"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Prints one line per query: status, rows (spark/duckdb), first difference.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if hasattr(v, "__float__") and type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def compare(spark, con, name, entry, sf_dir):
    t0 = time.time()
    sdf = entry.build(spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    t1 = time.time()
    if entry.sql is None:
        return "NOSQL", len(srows), None, f"{t1 - t0:.1f}s", ""
    rel = con.execute(entry.sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    t2 = time.time()
    timing = f"spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sorted(scols) != sorted(dcols):
        return "COLS", len(srows), len(drows), timing, f"{sorted(scols)} vs {sorted(dcols)}"
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s = sorted((tuple(norm(r[i]) for i in si) for r in srows), key=repr)
    d = sorted((tuple(norm(r[i]) for i in di) for r in drows), key=repr)
    if len(s) != len(d):
        return "ROWS", len(s), len(d), timing, ""
    for a, b in zip(s, d):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(order, a, b) if x != y][:4]
            return "VALUES", len(s), len(d), timing, str(diff)
    return "OK", len(s), len(d), timing, ""


def main():
    from shoplens.plans.registry import entries
    from shoplens.session import build_session
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    es = entries()
    bad = 0
    for name, e in es.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            st, ns, nd, timing, msg = compare(spark, con, name, e, sf_dir)
        except Exception as ex:  # report and continue
            st, ns, nd, timing, msg = "ERROR", None, None, "", repr(ex)[:400]
        bad += st not in ("OK", "NOSQL")
        print(f"{st:7s} {name:32s} {ns}/{nd} {timing} {msg}", flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main()
