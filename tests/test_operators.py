"""Operators beyond the registered queries, and random predicates against an independent engine."""

import math

import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import parse_moment
from lodestone.operators import aggregate, all_of, any_of, band, compare, join, join_using, order_by, top_k, trim_equal
from lodestone.operators.aggregates import call


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        compare("a", "~", 1)
    with pytest.raises(ValueError):
        call("median", "a")


def test_empty_aggregate(spark):
    r = aggregate(spark.range(0), s=("sum", "id"), lo=("MIN", "id"), a=("avg", "id"), n=("count", "*")).first()
    assert r.s is None and r.lo is None and r.a is None and r.n == 0


def test_trim_equal(spark):
    l = spark.createDataFrame([(1, " a\t"), (2, "b"), (3, None)], "i int, x string")
    r = spark.createDataFrame([(1, "a\r\n"), (2, "B"), (3, None)], "j int, y string")
    assert [tuple(x) for x in join(l, r, trim_equal("x", "y")).select("i", "j").collect()] == [(1, 1)]


def test_join_needs_a_condition_and_keeps_its_type(spark):
    with pytest.raises(ValueError):
        join(spark.range(1), spark.range(1))
    a, b = spark.range(3).alias("a"), spark.range(2).alias("b")
    assert join(a, b, F.col("a.id") == F.col("b.id"), how="left").count() == 3
    assert join(a, b, F.col("a.id") == F.col("b.id"), how="left_anti").count() == 1


def test_band_join(spark):
    points = spark.createDataFrame([(float(i),) for i in range(50)] + [(None,)], "x double")
    spans = spark.createDataFrame([(0, -3.0, 4.5), (1, 10.0, 10.0), (2, 8.0, 2.0), (3, None, 1.0), (4, 44.5, 99.0)], "k int, lo double, hi double")
    got = sorted((r.k, r.x) for r in band(points, spans, "x", "lo", "hi", 7.0).collect())
    assert got == sorted([(0, float(i)) for i in range(5)] + [(1, 10.0)] + [(4, float(i)) for i in range(45, 50)])


def test_sorting_with_nulls_and_negatives(spark):
    df = spark.createDataFrame([(-3.0,), (None,), (2.0,), (-1.0,), (0.0,)], "x double")
    assert [r.x for r in order_by(df, "x asc nulls last").collect()] == [-3.0, -1.0, 0.0, 2.0, None]
    assert [r.x for r in top_k(df, 2, "x desc").collect()] == [2.0, 0.0]


def test_moments(spark):
    df = spark.createDataFrame([("2024-02-29 01:02:03",), ("2024-02-29",), ("2021-02-31",), ("x",), (None,)], "t string")
    assert [None if r[0] is None else str(r[0]) for r in df.select(parse_moment("t")).collect()] == ["2024-02-29 01:02:03", "2024-02-29 00:00:00", None, None, None]


ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.sampled_from(["a", "b", "", None])), max_size=8)
TERM = st.one_of(
    st.tuples(st.just("x"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.integers(-2, 2)),
    st.tuples(st.just("s"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.sampled_from(["a", "b", ""])),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, st.lists(TERM, min_size=1, max_size=3), st.lists(TERM, min_size=1, max_size=2))
def test_random_predicates(spark, rows, both, either):
    df = spark.createDataFrame(rows, "x int, s string")
    got = df.filter(any_of(all_of(*[compare(*t) for t in both]), *[compare(*t) for t in either])).collect()
    sql = lambda t: f"{t[0]} {t[1]} {t[2]!r}"
    where = f"({' and '.join(map(sql, both))}) or {' or '.join(map(sql, either))}"
    t = pd.DataFrame(rows, columns=["x", "s"]).astype({"x": "Int64", "s": "object"})  # noqa: F841
    want = duckdb.sql(f"select x::int as x, s::varchar as s from t where {where}").fetchall()
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    assert sorted(map(repr, ((r.x, r.s) for r in got))) == sorted(map(repr, ((plain(a), plain(b)) for a, b in want)))


def test_join_using_keeps_one_key(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, p string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, q string")
    assert join_using(a, b, "k").columns == ["k", "p", "q"]
    with pytest.raises(ValueError):
        join_using(a, b)
