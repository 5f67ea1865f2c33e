"""Spark query vs. DuckDB oracle, the way the correctness gate compares them:
row count, column names, and the order-insensitive multiset of rows (columns
sorted by name, doubles compared at 6 decimals).

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphtables.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return round(v, 6)
    return v


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    return cols, out


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from __spark_entry__ import oracle_sql, queries
    q = queries()[name]
    t0 = time.perf_counter()
    df = q(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.perf_counter()
    res = {"query": name, "spark_rows": len(srows), "spark_s": round(t1 - t0, 2)}
    sql = oracle_sql().get(name)
    if sql is None:
        res["oracle"] = "none"
        return res
    rel = con.sql(sql)
    drows = rel.fetchall()
    res["oracle_rows"] = len(drows)
    sc, sr = canonical(df.columns, srows)
    dc, dr = canonical(list(rel.columns), drows)
    res["columns_match"] = sc == dc
    res["values_match"] = sr == dr
    if sc != dc:
        res["columns"] = (sc, dc)
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        res["first_diffs"] = diff
    return res


def main(argv: list[str]) -> int:
    from graphtables.session import local_session
    from __spark_entry__ import queries
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries())
    spark = local_session(8, 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as exc:  # report and continue
            r = {"query": n, "error": repr(exc)[:400]}
        ok = r.get("oracle") == "none" or (r.get("columns_match") and r.get("values_match"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "FAIL"), r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
