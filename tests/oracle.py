"""Compare a query with its DuckDB SQL by sorted rows."""

from __future__ import annotations

import datetime
import os

import duckdb

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = DIR):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v
    return sorted(tuple(repr(fix(r[i])) for i in order) for r in rows)


def same(df, sql: str, con) -> None:
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    want, got = plain(rel.fetchall(), rel.columns), plain([tuple(r) for r in df.collect()], df.columns)
    assert len(want) == len(got), (len(got), len(want))
    assert want == got, next((g, w) for g, w in zip(got, want) if g != w)
