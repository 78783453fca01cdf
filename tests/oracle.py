"""Comparison of a registered query with its SQL. ``python tests/oracle.py [names]`` runs it by hand."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v + 0.0:.9g}"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return f"{type(v).__name__}:{v}" if not isinstance(v, str) else v

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, plan, sql, folder):
    """Empty string if equal, else what differs."""
    t = time.time()
    df = plan(spark, folder)
    got_c, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    t_spark = time.time() - t
    if sql is None:
        return "" if got else "no rows", len(got), t_spark, 0.0
    t = time.time()
    res = con.execute(sql)
    want_c, want = canonical([d[0] for d in res.description], res.fetchall())
    t_sql = time.time() - t
    if got_c != want_c:
        return f"columns {got_c} != {want_c}", len(got), t_spark, t_sql
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return (f"{len(got)} vs {len(want)} rows; only spark {len(a)}, only sql {len(b)}\n"
                f"   {[str(x)[:400] for x in sorted(a)[:2]]}\n   {[str(x)[:400] for x in sorted(b)[:2]]}"), len(got), t_spark, t_sql
    return "", len(got), t_spark, t_sql


if __name__ == "__main__":
    import os

    import __spark_entry__ as e
    from docweave.session import local_session

    folder = f"{DATA}/{os.environ.get('SF', 'sf0.01')}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = e.oracle_sql()
    bad = []
    for name, plan in e.queries().items():
        if len(sys.argv) > 1 and not any(a in name for a in sys.argv[1:]):
            continue
        try:
            why, n, ts, td = compare(spark, con, name, plan, oracles.get(name), folder)
        except Exception as exc:  # report and go on
            why, n, ts, td = f"{type(exc).__name__}: {str(exc)[:900]}", 0, 0, 0
        print(f"{'ok ' if not why else 'BAD'} {name:24s} rows={n:6d} spark={ts:6.2f}s sql={td:6.2f}s {'(no sql)' if name not in oracles else ''} {why}", flush=True)
        if why:
            bad.append(name)
    print("failed:", bad)
