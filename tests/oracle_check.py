"""Run registered queries on Spark and their SQL oracles on DuckDB, and compare.

Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``.  The comparison is
order-insensitive: same column names, same row count, same multiset of rows
(floats compared to 1e-6 relative).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2**53:
            return int(v)
        return round(v, 6) if abs(v) < 1e9 else float(f"{v:.12g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].astype(object).itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (x is pd.NaT or (isinstance(x, float) and math.isnan(x))) else x)
                         for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = _rows(spark_pdf), _rows(duck_pdf)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return False, f"first differing row #{i}:\n  spark {x}\n  duck  {y}"
    return True, f"{len(a)} rows equal"


def check(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    con = duck_connection(sf_dir)
    results = {}
    for name in names or sorted(queries):
        t0 = time.time()
        try:
            sdf = queries[name](spark, sf_dir).toPandas()
        except Exception as exc:  # report and continue
            results[name] = (False, f"spark error: {type(exc).__name__}: {str(exc)[:400]}")
            if verbose:
                print(f"FAIL {name}: {results[name][1]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracle:
            results[name] = (True, f"{len(sdf)} rows (no oracle)")
        else:
            try:
                ddf = con.execute(oracle[name]).fetchdf()
                results[name] = compare(sdf, ddf)
            except Exception as exc:
                results[name] = (False, f"duckdb error: {type(exc).__name__}: {str(exc)[:400]}")
        if verbose:
            ok, msg = results[name]
            print(f"{'ok  ' if ok else 'FAIL'} {name} [{t1 - t0:.1f}s]: {msg}", flush=True)
    return results


if __name__ == "__main__":
    from claimlake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session()
    res = check(spark, sf, sys.argv[2:] or None)
    bad = [k for k, (ok, _) in res.items() if not ok]
    print(f"{len(res) - len(bad)}/{len(res)} ok; failing: {bad}")
    spark.stop()
