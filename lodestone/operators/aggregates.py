"""Aggregates: partial on each partition, then one small final row, or a row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
FUNCTIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def call(name: str, column: str | Column) -> Column:
    """One of sum, avg, min, max, count by name, in any case; count takes '*' too."""
    f = FUNCTIONS.get(name.lower())
    if f is None:
        raise ValueError(f"unknown aggregate {name!r}")
    return f(F.lit(1)) if isinstance(column, str) and column == "*" else f(column)


def exact_sum(column: str) -> Column:
    """A sum that does not depend on the order of addition, for columns of two decimals."""
    return F.sum(F.col(column).cast(MONEY)).cast("double")


def outputs_of(outputs: dict[str, tuple[str, str] | Column]) -> list[Column]:
    return [(call(*v) if isinstance(v, tuple) else v).alias(k) for k, v in outputs.items()]


def aggregate(df: DataFrame, **outputs: tuple[str, str] | Column) -> DataFrame:
    """aggregate(df, total=("sum", "price"), n=("count", "*")). Empty input gives nulls, and 0 for counts."""
    return df.agg(*outputs_of(outputs))


def group(df: DataFrame, by: list[str], *, grouping: str = "groupBy", having: Column | None = None, **outputs: tuple[str, str] | Column) -> DataFrame:
    """A row for each group; grouping may be rollup or cube; having is a condition on the outputs."""
    out = getattr(df, grouping)(*by).agg(*outputs_of(outputs))
    return out if having is None else out.filter(having)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of the columns, or of all."""
    return (df.select(*columns) if columns else df).distinct()
