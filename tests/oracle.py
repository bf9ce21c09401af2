"""Compares a query with its SQL counterpart run by DuckDB, without regard to row order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if hasattr(x, "item") and not hasattr(x, "__len__"):
            x = x.item()
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{x:.6f}"
        return pd.Timestamp(x).isoformat() if hasattr(x, "isoformat") else str(x)

    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


def check(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
