"""Compare a registered query with its SQL check on DuckDB, the way values are hashed: columns by
name, rows in any order, floats to six digits."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, query) -> tuple[bool, str]:
    df = query.run(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return True, f"rows={len(got[1])} (no check)"
    rel = connect(sf_dir).sql(query.sql)
    want = canonical(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    if got[1] == want[1]:
        return True, f"rows={len(got[1])}"
    a, b = set(got[1]), set(want[1])
    return False, f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b, key=repr)[:3]}; only sql {sorted(b - a, key=repr)[:3]}"
