"""Holding a query's rows against DuckDB's."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def assert_same(df, sf_dir: str, sql: str) -> None:
    names, rows = oracle(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in rows)
    assert ours == theirs
