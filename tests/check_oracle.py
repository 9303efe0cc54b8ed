"""Compare registered queries with their DuckDB twins: python tests/check_oracle.py [name-prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from flowlens.session import get_spark  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
KIND = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "long", "double": "double",
        "string": "str", "varchar": "str", "boolean": "bool", "timestamp_ntz": "ts", "timestamp": "ts", "float": "float"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return ("0null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("num", v + 0.0)
    if isinstance(v, int):
        return ("num", float(v)) if abs(v) < 2**53 else ("int", v)
    return (type(v).__name__, str(v))


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(cell(r[c]) for c in cols) for r in df.collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    types = {c: KIND.get(dict(df.dtypes)[c], dict(df.dtypes)[c]) for c in cols}
    other = {c: KIND.get(str(t).lower(), str(t).lower()) for c, t in zip(rel.columns, rel.types)}
    bad_types = {c: (types[c], other[c]) for c in cols if types[c] != other[c]}
    order = [rel.columns.index(c) for c in cols]
    want = [tuple(cell(r[i]) for i in order) for r in rel.fetchall()]
    note = f"types {bad_types}" if bad_types else None
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)} {note or ''}"
    got.sort(key=repr), want.sort(key=repr)
    if got != want:
        extra = [g for g in got if g not in set(want)][:2] if len(got) < 5000 else []
        for g, w in zip(got, want):
            if g != w:
                return f"{cols}\n   spark {g}\n   duck  {w}\n   extra {extra} {note or ''}"
    return f"ok-but-{note}" if note else None


def main(names: list[str], sf_dir: str) -> int:
    spark, con = get_spark("oracle", 8), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                diff = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        took = time.time() - start
        if diff:
            bad += 1
        print(f"{'FAIL' if diff else 'ok  '} {name} {took:.1f}s {diff or ''}", flush=True)
    print(f"{bad} failing of {len(queries)} ({len(oracles)} with SQL)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01")) else 0)
