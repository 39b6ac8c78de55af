"""Predicates: the six comparators, conjunction and disjunction. A null operand fails the row."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARATORS = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(left: str | Column, op: str, right) -> Column:
    """left op right; a string on the left names a column, the right side is a column or a constant."""
    if op not in COMPARATORS:
        raise ValueError(f"unknown comparator {op!r}")
    left = F.col(left) if isinstance(left, str) else left
    return COMPARATORS[op](left, right if isinstance(right, Column) else F.lit(right))


def between(column: str | Column, low, high) -> Column:
    """Both bounds belong to the range."""
    return all_of(compare(column, ">=", low), compare(column, "<=", high))


def is_in(column: str, *values) -> Column:
    return F.col(column).isin(list(values))


def like(column: str, pattern: str) -> Column:
    """% stands for any characters, _ for one; the backslash takes their meaning away."""
    return F.col(column).like(pattern)


def is_null(column: str) -> Column:
    return F.col(column).isNull()


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def all_of(*terms: Column) -> Column:
    return F.lit(True) if not terms else reduce(operator.and_, terms)


def any_of(*terms: Column) -> Column:
    return F.lit(False) if not terms else reduce(operator.or_, terms)
