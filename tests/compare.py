"""Spark rows against DuckDB's."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def duck(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame, tolerance: float = 2e-6) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert len(got) == len(want)
    exact = [c for c in cols if not pd.api.types.is_float_dtype(got[c])]
    key = exact + [c for c in cols if c not in exact]
    a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if c in exact:
            assert a[c].astype(object).where(a[c].notna(), None).tolist() == b[c].astype(object).where(b[c].notna(), None).tolist(), c
        else:
            x, y = a[c].astype(float), b[c].astype(float)
            assert (x.isna() == y.isna()).all(), c
            assert ((x - y).abs() <= tolerance * (1 + y.abs())).where(y.notna(), True).all(), c
