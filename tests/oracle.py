"""Compare registered queries with their SQL in DuckDB, ignoring row order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from panelspark.plans.catalog import QUERIES  # noqa: E402
from panelspark.session import local_session  # noqa: E402
from panelspark.views import BASE_TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '4GB'")  # a wrong join ends here, not with a full disk
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _kind(v):
    return type(v).__name__ if v is not None else None


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else a description of the first difference."""
    q = QUERIES[name]
    df = q.spark(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = q.sql()
    if sql is None:
        return None
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    for c in cols:
        i, j = df.columns.index(c), cols.index(c)
        a = {_kind(r[i]) for r in got} - {None}
        b = {_kind(r[j]) for r in want} - {None}
        if a != b and a and b:
            return f"column {c}: types {a} != {b}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(cols)}\n   spark {x}\n   sql   {y}\n   ({sum(p != q for p, q in zip(a, b))} of {len(a)} rows differ)"
    return None if a else "EMPTY"


if __name__ == "__main__":
    sf = sys.argv[1]
    names = [n for n in QUERIES if not sys.argv[2:] or any(p in n for p in sys.argv[2:])]
    spark, con = local_session(), connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            diff = compare(spark, con, sf, n)
        except Exception as e:  # noqa: BLE001 - a broken query must not hide the others
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        note = "ok" if QUERIES[n].oracle else "rows"
        print(f"{n:40s} {time.time() - t:6.2f}s {note if diff is None else 'FAIL ' + diff}", flush=True)
    print(f"{bad} of {len(names)} failed")
