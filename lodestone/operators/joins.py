"""Joins. The strategy is left to the planner and to adaptive execution: no side is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.predicates import all_of, compare


def join(left: DataFrame, right: DataFrame, *conditions: Column, how: str = "inner") -> DataFrame:
    """All conditions hold at once. Name the sides with df.alias() where column names clash."""
    if not conditions:
        raise ValueError("a join needs a condition")
    return left.join(right, all_of(*conditions), how)


def join_using(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Equality of the named columns, of which the result has one copy."""
    if not names:
        raise ValueError("a join needs a condition")
    return left.join(right, list(names), how)


def join_all(first: DataFrame, *rest: tuple[DataFrame, Column]) -> DataFrame:
    """A chain of inner joins; the optimizer may reorder it."""
    for df, condition in rest:
        first = join(first, df, condition)
    return first


def join_either(left: DataFrame, right: DataFrame, first: Column, second: Column) -> DataFrame:
    """Pairs that meet one of two conditions: those of the first, and those of the second alone. Each part has the plan that its condition allows, an equality a hash or merge join."""
    return join(left, right, first).unionAll(join(left, right, second, ~F.coalesce(first, F.lit(False))))


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its group whose right_on is at or before on; null where there is none.

    Both sides are sorted once by (group, moment); nothing is paired.
    """
    mark = [F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).alias("_values")]
    rows = left.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_side"), *mark)
    held = F.struct(*values)
    found = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), held.alias("_values"))
    before = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(found).withColumn("_values", F.last("_values", ignorenulls=True).over(before))
    return both.filter("_side = 1").select("_row.*", *[F.col(f"_values.{v}").alias(v) for v in values])


def trimmed(text: str | Column) -> Column:
    """The text without its outer blanks, tabs and line ends."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\r\n"))


def trim_equal(left: str | Column, right: str | Column) -> Column:
    """Equality of texts without their outer blanks, tabs and line ends."""
    return trimmed(left) == trimmed(right)


def band(left: DataFrame, right: DataFrame, key: str, low: str, high: str, width: float, keep: Column | None = None) -> DataFrame:
    """Range join left.key between right.low and right.high as an equi-join on buckets of width.

    Each right row is copied to the buckets that it spans, so width should be near the usual span.
    Rows with a null or inverted range match nothing.
    """
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    spans = right.filter(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    rows = left.withColumn("_bucket", F.floor(F.col(key) / width))
    out = rows.join(spans, "_bucket").filter(compare(key, ">=", F.col(low)) & compare(key, "<=", F.col(high)))
    return (out.filter(keep) if keep is not None else out).drop("_bucket")
