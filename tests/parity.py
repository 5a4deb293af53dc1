"""Compares a Spark result with a DuckDB one: names, kinds of types, and the multiset of rows."""

from __future__ import annotations

import math

import duckdb

from tessera.tables import TABLES

#: Kinds that agree between both engines.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def compare(df, con, sql: str) -> None:
    rel = con.sql(sql)
    ours, theirs = sorted(df.columns), sorted(rel.columns)
    assert ours == theirs
    kinds = dict(df.dtypes)
    other = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for c in ours:
        assert KINDS[kinds[c]] == other[c], (c, kinds[c], other[c])

    def key(row):
        return [(v is None, str(type(v)), v if v is not None else 0) for v in row]

    a = sorted((tuple(_plain(r[c]) for c in ours) for r in df.collect()), key=key)
    b = sorted((tuple(map(_plain, r)) for r in rel.select(*[f'"{c}"' for c in ours]).fetchall()), key=key)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
