"""Compares named queries with their SQL: ``python check.py [folder] [name part ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from launchsift.plans import catalogue
from launchsift.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or (not isinstance(v, (list, tuple, str, bytes)) and pd.isna(v)):
                cells.append("null")
            elif isinstance(v, (bool,)) or type(v).__name__ in ("bool_", "bool"):
                cells.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal":
                cells.append(repr(float(v)))
            else:
                cells.append(str(v))
        rows.append(tuple(cells))
    return sorted(rows)


def compare(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    a, b = normal(spark_rows), normal(sql_rows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    return "ok"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con, failed = local_session(), connect(folder), []
    for q in catalogue.all_queries():
        if parts and not any(p in q.name for p in parts):
            continue
        start = time.time()
        try:
            got = q(spark, folder).toPandas()
            took = time.time() - start
            if q.sql is None:
                outcome = "rows only"
            else:
                want = con.execute(q.sql).df()
                outcome = compare(got, want)
                for c in got.columns:
                    if c in want.columns and got[c].dtype.kind != want[c].dtype.kind:
                        print(f"  note: {q.name}.{c} is {got[c].dtype} here and {want[c].dtype} in SQL")
            size = len(got)
        except Exception as err:  # report and go on
            outcome, size, took = f"error {str(err)[:1500]}", -1, time.time() - start
        if outcome not in ("ok", "rows only"):
            failed.append(q.name)
        print(f"{q.name:34s} {size:8d} {took:7.2f}s {outcome}", flush=True)
    print("FAILED", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
