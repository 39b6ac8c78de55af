"""Column expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def wall_clock(text: str) -> Column:
    """A timestamp literal without a zone, from 'yyyy-MM-dd HH:mm:ss'."""
    return F.to_timestamp_ntz(F.lit(text))


#: What the typed files write: a date, with a time of day or without, to the microsecond.
MOMENT = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$"


def parse_moment(column: str | Column) -> Column:
    """A wall-clock timestamp from 'yyyy-MM-dd' or 'yyyy-MM-dd HH:mm:ss' with a fraction or without, outer blanks aside; null where the text is no such moment."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.when(text.rlike(MOMENT), text.try_cast("timestamp_ntz"))


def exclusive_sum(value: str | Column, by: list[str], *order: str | Column) -> Column:
    """The sum of value over the rows before this one in its group, 0 at the first."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))
