"""Compares a query with its SQL on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def _text(v) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


def same_rows(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(tuple(map(_text, r)) for r in x[columns].itertuples(index=False)) for x in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert [(a, b) for a, b in zip(*rows, strict=True) if a != b][:3] == []
