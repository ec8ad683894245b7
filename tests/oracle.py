"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def tidy(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            missing = v is None or (not isinstance(v, (list, dict)) and not hasattr(v, "__len__") and pd.isna(v))
            cells.append("" if missing else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v))
        out.append(tuple(cells))
    return sorted(out)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = tidy(got), tidy(want)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, wrong[:3]
