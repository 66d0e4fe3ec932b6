"""Rows of a query against rows of its SQL."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    """A value as Python has it, so that equal values have equal texts."""
    if isinstance(x, np.ndarray):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if pd.isna(x):
        return None
    x = x.item() if isinstance(x, np.generic) else x
    return int(x) if isinstance(x, float) and x.is_integer() else x  # integers beside nulls come as either


def rows(pdf) -> list[str]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in zip(*(pdf[c].tolist() for c in pdf.columns)))


def same(df, sql: str, con) -> None:
    have, want = df.toPandas(), con.execute(sql).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)
