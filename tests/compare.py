"""Runs registered queries next to their comparison SQL: python -m tests.compare [sf] [name...]"""

from __future__ import annotations

import hashlib
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return None if math.isnan(v) else ("n", round(v, 9) + 0.0)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_cell(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def run_duck(con, sql):
    con.execute(sql)
    names = [d[0] for d in con.description]
    return names, con.fetchall()


def compare(spark, con, query, sf_dir, show=3):
    t = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if query.oracle is None:
        return "rows-only", len(rows), took, ""
    t = time.time()
    names, want = run_duck(con, query.oracle)
    oracle_took = time.time() - t
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(rows), took, f"{sorted(df.columns)} != {sorted(names)}"
    a, la = digest(df.columns, rows)
    b, lb = digest(names, want)
    if a == b:
        return "ok", len(rows), took, f"{oracle_took:.1f}"
    extra = sorted(set(la) - set(lb))[:show]
    miss = sorted(set(lb) - set(la))[:show]
    return "DIFF", len(rows), took, f"spark {len(la)} oracle {len(lb)}\n   + " + "\n   + ".join(
        e[:600] for e in extra) + "\n   - " + "\n   - ".join(m[:600] for m in miss)


def main():
    from casetrail.plans import QUERIES
    from casetrail.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    names = [n for n in QUERIES if not args[1:] or any(
        a in n or (a[0] == '@' and a[1:] in QUERIES[n].build.__module__) for a in args[1:])]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.driver.host": "localhost"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            state, count, took, note = compare(spark, con, QUERIES[n], sf_dir)
        except Exception as e:  # report and go on
            state, count, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += state not in ("ok", "rows-only")
        print(f"{state:9} {n:34} {count:7} {took:5.1f}s {note}", flush=True)
    print("queries", len(names), "bad", bad)


if __name__ == "__main__":
    main()
