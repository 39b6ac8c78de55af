"""Comparing a query with its SQL on an independent engine."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_plain, r)) for r in df.itertuples(index=False)), key=repr)


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v)
    return float(f"{v:.9g}") if isinstance(v, float) else (v.item() if hasattr(v, "item") else v)
