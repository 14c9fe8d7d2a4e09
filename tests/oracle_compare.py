"""Run registered queries in Spark and their SQL in DuckDB, compare results.

Comparison: same column names, same row count, and the same multiset of
rows (columns sorted by name, rows sorted, values normalised: dates and
timestamps to ISO text, integers and floats to float).

CLI: ``python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]``
"""

from __future__ import annotations

import datetime as _dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "__float__") and not isinstance(v, str):
        return float(v)
    return str(v)


def _rows(cols: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, "" if x is None else (str(type(x)), x)) for x in r))
    return [cols[i] for i in order], out


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict[str, dict]:
    import __spark_entry__ as ep

    qs = ep.queries()
    sql = ep.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        rec: dict = {}
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
            rec["spark_rows"] = len(s_rows)
            rec["spark_sec"] = round(time.time() - t0, 2)
            if name in sql:
                cur = con.execute(sql[name])
                d_cols = [d[0] for d in cur.description]
                d_rows = cur.fetchall()
                rec["sql_rows"] = len(d_rows)
                sc, sr = _rows(s_cols, s_rows)
                dc, dr = _rows(d_cols, d_rows)
                rec["cols_match"] = sc == dc
                rec["count_match"] = len(sr) == len(dr)
                rec["values_match"] = sr == dr
                rec["ok"] = rec["cols_match"] and rec["count_match"] and rec["values_match"]
                if not rec["ok"]:
                    rec["spark_cols"], rec["sql_cols"] = sc, dc
                    diff_s = [r for r in sr if r not in set(dr)][:3]
                    diff_d = [r for r in dr if r not in set(sr)][:3]
                    rec["only_spark"], rec["only_sql"] = diff_s, diff_d
            else:
                rec["ok"] = True
                rec["note"] = "no oracle (rows only)"
        except Exception as exc:  # report and continue
            rec["ok"] = False
            rec["error"] = f"{type(exc).__name__}: {str(exc)[:400]}"
        report[name] = rec
        if verbose:
            print(name, "OK" if rec["ok"] else "FAIL", {k: v for k, v in rec.items() if k != "ok"}, flush=True)
    return report


if __name__ == "__main__":
    from orderscope.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8)
    rep = compare(spark, sf, only)
    bad = [k for k, v in rep.items() if not v["ok"]]
    print(f"\n{len(rep) - len(bad)}/{len(rep)} ok; failing: {bad}")
