"""Every relational query against its SQL, and the order of the sorts."""

import pytest

from lodestone.plans.registry import QUERIES
from lodestone.plans.sql import SQL
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.01"


def test_names_match():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = oracle(SF, SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name, keys", [("sort_num_asc", ["c_acctbal"]), ("sort_str_asc", ["p_name"]), ("sort_date_asc", ["o_orderdate"])])
def test_ascending(spark, name, keys):
    got = QUERIES[name](spark, SF).toPandas()
    assert got[keys[0]].is_monotonic_increasing


@pytest.mark.parametrize("name, key", [("sort_num_desc", "c_acctbal"), ("sort_str_desc", "p_name"), ("sort_date_desc", "ts")])
def test_descending(spark, name, key):
    got = QUERIES[name](spark, SF).toPandas()
    assert got[key].is_monotonic_decreasing
    if name == "sort_num_desc":
        assert got[key].iloc[0] > 0 > got[key].iloc[-1]


def test_multi_key(spark):
    got = QUERIES["sort_multi_key"](spark, SF).toPandas()
    want = got.sort_values(["o_orderstatus", "o_totalprice"], ascending=[True, False], kind="stable")
    assert got.o_totalprice.tolist() == want.o_totalprice.tolist()
