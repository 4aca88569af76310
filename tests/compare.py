"""Compare a query with its DuckDB SQL: columns, row count, values regardless of order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def view(con, sf_dir: str) -> None:
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE OR REPLACE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(names: list[str], data) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    view(con, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    got, expected = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert len(got) == len(expected), (len(got), len(expected))
    for a, b in zip(got, expected):
        assert a == b, (a, b)
