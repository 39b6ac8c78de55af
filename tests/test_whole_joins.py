"""The whole joins on a small fixture, by brute force: every row of both tables reaches the condition."""

import operator

import pandas as pd
import pytest

from lodestone.plans.registry import QUERIES


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    days = pd.to_datetime(["1995-01-01", "1996-02-02", None, "1997-03-03"])
    made = {
        "customer": pd.DataFrame({"c_custkey": [1, 99, 100, 499, 500, 9000], "c_acctbal": [-5.0, 3.0, 7.5, 3.0, None, 900.0], "c_nationkey": [0, 1, 2, 2, 1, 0]}),
        "supplier": pd.DataFrame({"s_suppkey": [1, 2, 3], "s_acctbal": [3.0, 8.0, None]}),
        "nation": pd.DataFrame({"n_nationkey": [0, 1, 2]}),
        "orders": pd.DataFrame({"o_orderkey": [1, 2, 3, 4], "o_orderdate": days, "o_totalprice": [10.0, 500000.0, 600000.0, 1.0]}),
        "lineitem": pd.DataFrame({"l_orderkey": [7, 8, 9], "l_linenumber": [1, 1, 2], "l_shipdate": days[[0, 1, 2]]}),
    }
    folder = tmp_path_factory.mktemp("whole")
    for name, df in made.items():
        for c in df.select_dtypes("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df.to_parquet(folder / f"{name}.parquet")
    return str(folder), made


@pytest.mark.parametrize(
    "name, sides, columns, op",
    [
        ("join_theta_lt", ("customer", "supplier"), ("c_acctbal", "s_acctbal"), operator.lt),
        ("join_theta_gt", ("customer", "supplier"), ("c_acctbal", "s_acctbal"), operator.gt),
        ("join_theta_le", ("customer", "nation"), ("c_nationkey", "n_nationkey"), operator.le),
        ("join_theta_ge", ("customer", "nation"), ("c_nationkey", "n_nationkey"), operator.ge),
        ("join_equi_date", ("lineitem", "orders"), ("l_shipdate", "o_orderdate"), operator.eq),
    ],
)
def test_whole_join(spark, tables, name, sides, columns, op):
    folder, made = tables
    got = QUERIES[name](spark, folder)
    both = made[sides[0]].merge(made[sides[1]], how="cross")
    want = both[[not pd.isna(a) and not pd.isna(b) and op(a, b) for a, b in zip(both[columns[0]], both[columns[1]])]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want[got.columns].itertuples(index=False, name=None))
