"""Compare a Spark result with DuckDB's on the same Parquet files."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame

# Spark type -> DuckDB type the oracle must return.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
    "array<float>": "FLOAT[]",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from '{files}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), repr(v)) for v in row)


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(value)
    return value


def differences(con: duckdb.DuckDBPyConnection, result: DataFrame, sql: str) -> list[str]:
    """What differs, as sentences; empty if schema, count and all values agree."""
    found = []
    expected = con.sql(sql)
    theirs = dict(zip(expected.columns, map(str, expected.types)))
    ours = {name: TYPES.get(kind, kind) for name, kind in result.dtypes}
    if sorted(theirs) != sorted(ours):
        return [f"columns {sorted(ours)} but expected {sorted(theirs)}"]
    found += [f"{c}: {ours[c]} but expected {theirs[c]}" for c in ours if ours[c] != theirs[c]]
    names = sorted(ours)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in result.collect()), key=_key)
    want_rel = expected.select(*[duckdb.ColumnExpression(n) for n in names])
    want = sorted((tuple(map(_plain, r)) for r in want_rel.fetchall()), key=_key)
    if len(got) != len(want):
        found.append(f"{len(got)} rows but expected {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        near = all(
            a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b))
            for a, b in zip(g, w)
        )
        found.append(f"{len(bad)} rows differ{' in the last digit' if near else ''}: {g} / {w}")
    return found
