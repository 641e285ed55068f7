"""Spark results against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d=DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: str(list(v)) if hasattr(v, "tolist") and not pd.api.types.is_scalar(v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_df, sql, d=DATA):
    got, want = normal(spark_df.toPandas()), normal(connect(d).execute(sql).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)
