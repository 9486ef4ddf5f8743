"""Compare a query with its SQL on the same tables, ignoring row order and column order."""

from __future__ import annotations

import functools

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@functools.cache
def database(sf: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def normal(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        if df[c].dtype.kind == "f" or (len(df) and type(df[c].iloc[0]).__name__ == "Decimal"):
            df[c] = df[c].astype(float).round(5)
    return df.astype(str).sort_values(cols).reset_index(drop=True)


def same(spark, sf: str, query, sql: str) -> int:
    """How many rows both give."""
    got, want = query(spark, sf).toPandas(), database(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    assert a.equals(b), (a[(a != b).any(axis=1)].head(), b[(a != b).any(axis=1)].head())
    return len(a)
