"""Results of both engines as comparable rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(norm(r[i]) for i in order) for r in found), key=repr)


def connection(data: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = rows(columns, cur.fetchall())
    assert sorted(columns) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, bad[:3]
