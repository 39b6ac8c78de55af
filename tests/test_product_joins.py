"""Joins that grow with the product of groups: whole results from many small blocks, made by many tasks."""

import itertools
import math
import operator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import compare, join_groups, join_ordered, products
from lodestone.plans.registry import QUERIES

NAN = float("nan")
LEFT = [(i, v) for i, v in enumerate([3.0, 3.0, 3.0, 3.0, -1.0, None, 0.0, -0.0, 7.5, NAN, 3.0, 12.0, float("inf"), 3.0])] + [(0, 3.0)]
RIGHT = [(10 * i, v) for i, v in enumerate([3.0, 3.0, None, 0.0, NAN, 8.0, -2.0, 3.0, 3.0, 3.0, float("-inf")])]


def plain(rows):
    return sorted(map(repr, rows))


def greatest(v):
    """Spark's order: NaN after all numbers, and equal to itself."""
    return (1, 0.0) if math.isnan(v) else (0, v)


@pytest.fixture(params=[(3, 2), (4096, 256)])
def blocks(request, monkeypatch):
    monkeypatch.setattr(products, "BLOCK", request.param[0])
    monkeypatch.setattr(products, "RUN", request.param[1])


@pytest.mark.parametrize("op, f", [("<", operator.lt), ("<=", operator.le), (">", operator.gt), (">=", operator.ge)])
def test_ordered(spark, blocks, op, f):
    l, r = spark.createDataFrame(LEFT, "i int, x double"), spark.createDataFrame(RIGHT, "j int, y double")
    got = join_ordered(l, r, "x", op, "y").select("i", "j").collect()
    want = [(i, j) for (i, x), (j, y) in itertools.product(LEFT, RIGHT) if x is not None and y is not None and f(greatest(x), greatest(y))]
    assert plain(map(tuple, got)) == plain(want)
    assert join_ordered(l.limit(0), r, "x", op, "y").count() == 0
    assert join_ordered(l, r.limit(0), "x", op, "y").columns == ["i", "x", "j", "y"]


def test_ordered_needs_an_order(spark):
    with pytest.raises(ValueError):
        join_ordered(spark.range(1), spark.range(1).toDF("j"), "id", "<>", "j")


def test_groups(spark, blocks):
    left = [(k, i, v) for (i, v), k in zip(LEFT, ["a", "a", "a", "a", None, "b", "a", "c", "a", "a", "a", "a", "c", "d", "a"])]
    right = [(k, j, v) for (j, v), k in zip(RIGHT, ["a", "a", "a", "c", "a", None, "a", "a", "a", "e", "a"])]
    l, r = spark.createDataFrame(left, "k string, i int, x double"), spark.createDataFrame(right, "k string, j int, y double")
    pairs = [(a, b) for a, b in itertools.product(left, right) if a[0] is not None and a[0] == b[0]]
    got = join_groups(l, r, "k")
    assert got.columns == ["k", "i", "x", "j", "y"]
    assert plain(map(tuple, got.collect())) == plain((*a, *b[1:]) for a, b in pairs)
    some = join_groups(l, r, "k", compare("x", "<>", F.col("y"))).select("i", "j").collect()
    assert plain(map(tuple, some)) == plain((a[1], b[1]) for a, b in pairs if a[2] is not None and b[2] is not None and greatest(a[2]) != greatest(b[2]))
    assert join_groups(l.limit(0), r, "k").count() == join_groups(l, r.limit(0), "k").count() == 0


@pytest.fixture(scope="module")
def one_key(tmp_path_factory):
    """Tables in which nearly all rows of both sides share one key, each in one small file."""
    n = 600
    made = {
        "customer": pd.DataFrame({"c_custkey": range(n), "c_nationkey": 1, "c_acctbal": [float(i % 50) for i in range(n)]}),
        "supplier": pd.DataFrame({"s_suppkey": range(n), "s_nationkey": 1, "s_acctbal": [float(i % 70) for i in range(n)]}),
        "part": pd.DataFrame({"p_partkey": range(n), "p_size": 1}),
        "orders": pd.DataFrame({"o_orderkey": range(n), "o_orderdate": pd.Timestamp("1995-01-01")}),
        "lineitem": pd.DataFrame({"l_orderkey": range(n), "l_linenumber": 1, "l_shipdate": pd.Timestamp("1995-01-01")}),
    }
    folder = tmp_path_factory.mktemp("one_key")
    for name, df in made.items():
        for c in df.select_dtypes("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df.to_parquet(folder / f"{name}.parquet")
    return str(folder), made


def dealt(df):
    """Pairs by task, and how many differ."""
    rows = df.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).collect()
    return [r.n for r in rows], df.distinct().count()


@pytest.mark.parametrize("name, left, right, keep", [
    ("join_equi_date", "lineitem", "orders", None),
    ("join_theta_gt", "customer", "supplier", operator.gt),
    ("join_theta_lt", "customer", "supplier", operator.lt),
    ("join_eq_and_ne", "customer", "supplier", operator.ne),
    ("join_equi_str", "supplier", "part", None),
])
def test_pairs_of_one_key_are_dealt_out(spark, one_key, monkeypatch, name, left, right, keep):
    monkeypatch.setattr(products, "BLOCK", 64)
    folder, made = one_key
    want = len(made[left]) * len(made[right])
    if keep:
        want = sum(keep(a, b) for a in made[left].c_acctbal for b in made[right].s_acctbal)
    tasks, different = dealt(QUERIES[name](spark, folder))
    assert sum(tasks) == different == want
    assert len(tasks) >= 8 and max(tasks) < want / 3
