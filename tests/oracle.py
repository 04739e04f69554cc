"""Holds a query's rows against DuckDB's."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))


def sql_rows(sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con.sql(sql).df()


def same(spark, query, sql: str) -> None:
    got, want = query(spark, DATA).toPandas(), sql_rows(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)
