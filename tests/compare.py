"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v == int(v) if isinstance(v, float) and math.isfinite(v) else False:
        return int(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]).upper() for d in result.description}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(c, t, types[c]) for c, t in spark_df.dtypes if kinds.get(t) != types[c]]
    expected = rows_of(names, result.fetchall())
    found = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(expected) != len(found):
        return f"{len(found)} rows, expected {len(expected)}; first {found[:2]} / {expected[:2]}"
    for a, b in zip(found, expected):
        if a != b:
            return f"{a} != {b}"
    return f"types only: {odd}" if odd else None
