"""Relational operators as functions from DataFrames to DataFrames."""

from lodestone.operators.aggregates import aggregate, distinct, group
from lodestone.operators.joins import asof, band, join, join_all, join_either, join_using, trim_equal, trimmed
from lodestone.operators.predicates import all_of, any_of, between, compare, is_in, is_null, like, not_null
from lodestone.operators.products import join_groups, join_ordered
from lodestone.operators.sorting import order_by, top_k

__all__ = ["aggregate", "all_of", "any_of", "asof", "band", "between", "compare", "distinct", "group", "is_in", "is_null", "join", "join_all", "join_either", "join_groups", "join_ordered", "join_using", "like", "not_null", "order_by", "top_k", "trim_equal", "trimmed"]
