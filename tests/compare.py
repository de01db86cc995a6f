"""Run catalog queries against their SQL and report differences."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row):
    return tuple((x is None, isinstance(x, str), x if not isinstance(x, float) or not math.isnan(x) else 1e300) for x in row)


def differences(df, con, sql: str) -> list[str]:
    """What differs in names, types, row count and values; values must be equal, not close."""
    found = []
    result = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(result.columns):
        return [f"columns {sorted(set(names) ^ set(result.columns))}"]
    types = dict(zip(result.columns, map(str, result.types)))
    for name, kind in df.dtypes:
        if KINDS.get(kind) != types[name]:
            found.append(f"type of {name}: {kind} and {types[name]}")
    order = [result.columns.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=_key)
    ours = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    if len(ours) != len(theirs):
        found.append(f"rows: {len(ours)} and {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        cols = sorted({n for a, b in bad[:50] for n, x, y in zip(names, a, b) if x != y})
        found.append(f"{len(bad)} rows differ in {cols}: {bad[0][0]} and {bad[0][1]}"[:700])
    return found
