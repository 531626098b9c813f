"""Compares a query with its SQL twin in DuckDB."""

import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(got, want) -> str:
    """Empty if two pandas frames hold the same rows in any order, else what differs."""
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    differ = (a != b).any(axis=1)
    return f"{differ.sum()} rows, such as {a[differ].head(2).to_dict()} and {b[differ].head(2).to_dict()}" if differ.any() else ""
