"""Total order: range exchange and local sort, by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    """Keys are 'name', 'name asc' or 'name desc', with an optional 'nulls first' or 'nulls last'."""
    return df.orderBy(*[_key(k) for k in keys])


def top_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    return order_by(df, *keys).limit(k)


def _key(text: str):
    name, *words = text.split()
    way = " ".join(words).lower() or "asc"
    f = {"asc": "asc", "desc": "desc", "asc nulls first": "asc_nulls_first", "asc nulls last": "asc_nulls_last", "desc nulls first": "desc_nulls_first", "desc nulls last": "desc_nulls_last"}.get(way)
    if f is None:
        raise ValueError(f"cannot read the sort key {text!r}")
    return getattr(F.col(name), f)()
