"""Run registered queries next to their SQL and compare rows, columns and values.

usage: python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def check(con, spark, fn, sql, sf_dir):
    """Empty string when equal, else a description of the first difference."""
    got = fn(spark, sf_dir)
    spark_rows = [tuple(r) for r in got.collect()]
    if sql is None:
        return "" if spark_rows else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} vs {sorted(names)}"
    a, b = rows_of(got.columns, spark_rows), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if not a:
        return "no rows"
    for x, y in zip(a, b):
        if x != y:
            return f"value {x} vs {y} ({sum(p != q for p, q in zip(a, b))} rows differ of {len(a)})"
    return ""


def main() -> None:
    import __spark_entry__ as E
    from scoreweave.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = build_session(), connect(sf_dir)
    queries, oracles, bad = E.queries(), E.oracle_sql(), 0
    for name in names or queries:
        t = time.time()
        try:
            diff = check(con, spark, queries[name], oracles.get(name), sf_dir)
        except Exception as ex:  # report and go on with the next query
            diff = f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += bool(diff)
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {time.time() - t:6.1f}s {name} {diff}", flush=True)
    print(f"{len(names or queries)} queries, {bad} failed")


if __name__ == "__main__":
    main()
