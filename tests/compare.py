"""Spark rows against DuckDB rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c.execute(sql).df()


def same(got, want) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df[names].itertuples(index=False))
    a, b = rows(got), rows(want)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
