"""The queries, as compositions of the operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import exclusive_sum, wall_clock
from lodestone.operators import aggregate, all_of, any_of, asof, band, between, compare, distinct, group, is_in, is_null, join, join_all, join_either, join_groups, join_ordered, join_using, like, not_null, order_by, top_k, trimmed
from lodestone.operators.aggregates import exact_sum
from lodestone.plans.sql import TEXTS
from lodestone.session import Engine
from lodestone.sources.tables import table

#: The tables that a directory of the registered queries holds.
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Tables:
    """The tables of a directory as attributes, each under its own alias."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(*self._at, name)


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def select_where(name: str, source: str, columns: str, *terms: tuple) -> None:
    """Registers a scan with a conjunction of comparisons and a projection."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, source).filter(all_of(*[compare(*_moment(t)) for t in terms])).select(*columns.split())


def _moment(term: tuple) -> tuple:
    """Constants of the form @... are wall-clock timestamps."""
    left, op, right = term
    return left, op, wall_clock(right[1:]) if isinstance(right, str) and right[:1] == "@" else right


@query
def scan_all(t):
    return t.orders


@query
def project_reorder(t):
    return t.orders.select("o_totalprice", "o_orderkey", "o_orderdate")


for _name, _op, _bound in (("eq", "=", 10), ("ne", "<>", 10), ("lt", "<", 10), ("le", "<=", 10), ("gt", ">", 40), ("ge", ">=", 40)):
    select_where(f"filter_num_{_name}", "lineitem", "l_orderkey l_linenumber", ("l_quantity", _op, _bound))
select_where("filter_str_eq", "customer", "c_custkey c_name", ("c_mktsegment", "=", "BUILDING"))
select_where("filter_str_ne", "customer", "c_custkey c_name", ("c_mktsegment", "<>", "BUILDING"))
select_where("filter_str_range", "customer", "c_custkey c_mktsegment", ("c_mktsegment", ">=", "F"), ("c_mktsegment", "<", "N"))
select_where("filter_date_eq", "orders", "o_orderkey", ("o_orderdate", "=", "@1998-10-03 00:00:00"))
select_where("filter_date_ne", "orders", "o_orderkey", ("o_orderdate", "<>", "@1998-10-03 00:00:00"))
select_where("filter_date_range", "orders", "o_orderkey o_orderdate", ("o_orderdate", ">=", "@1997-01-01 00:00:00"), ("o_orderdate", "<", "@1998-01-01 00:00:00"))
select_where("filter_date_time_of_day", "events", "event_id ts", ("ts", ">", "@2024-01-10 12:30:45"))
select_where("filter_and_multi_col", "orders", "o_orderkey", ("o_totalprice", ">", 200000), ("o_orderstatus", "=", "F"), ("o_orderdate", "<", "@1998-01-01 00:00:00"))


@query
def filter_col_vs_col(t):
    return t.lineitem.filter(compare("l_tax", ">", F.col("l_discount"))).select("l_orderkey", "l_linenumber")


@query
def filter_or(t):
    keep = any_of(compare("c_acctbal", ">", 9000), compare("c_mktsegment", "=", "MACHINERY"))
    return t.customer.filter(keep).select("c_custkey", "c_acctbal", "c_mktsegment")


@query
def filter_or_same_col(t):
    return t.customer.filter(any_of(compare("c_acctbal", ">", 9000), compare("c_acctbal", "<", 0))).select("c_custkey", "c_acctbal")


@query
def filter_nested_bool(t):
    dear = all_of(compare("o_totalprice", ">", 400000), compare("o_orderstatus", "=", "O"))
    cheap = all_of(compare("o_totalprice", "<", 2000), compare("o_orderstatus", "=", "F"))
    return t.orders.filter(any_of(dear, cheap)).select("o_orderkey")


@query
def filter_in(t):
    return t.customer.filter(is_in("c_mktsegment", "BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query
def filter_like(t):
    return t.part.filter(like("p_name", "%1_")).select("p_partkey", "p_name")


@query
def filter_between(t):
    return t.part.filter(between("p_retailprice", 950, 1000)).select("p_partkey", "p_retailprice")


@query
def filter_is_null(t):
    return join(t.customer, t.orders, on("c_custkey", "=", "o_custkey"), how="left").filter(is_null("o_orderkey")).select("c_custkey")


@query
def filter_not_null(t):
    return join(t.customer, t.orders, on("c_custkey", "=", "o_custkey"), how="left").filter(not_null("o_orderkey")).select("c_custkey", "o_orderkey")


@query
def agg_sum(t):
    return aggregate(t.lineitem, sum_price=exact_sum("l_extendedprice"))


@query
def agg_avg(t):
    return aggregate(t.lineitem, avg_qty=F.round(F.avg("l_quantity"), 6))


@query
def agg_min_max_num(t):
    return aggregate(t.customer, mn=("min", "c_acctbal"), mx=("max", "c_acctbal"))


@query
def agg_min_max_date(t):
    return aggregate(t.orders, mn=("min", "o_orderdate"), mx=("max", "o_orderdate"))


@query
def agg_count_star(t):
    return aggregate(t.lineitem, n=("count", "*"))


@query
def agg_count_col(t):
    return aggregate(t.orders, n=("count", "o_orderdate"))


@query
def agg_same_col_all(t):
    return aggregate(t.lineitem, s=("sum", "l_quantity"), a=F.round(F.avg("l_quantity"), 6), mn=("min", "l_quantity"), mx=("max", "l_quantity"), n=("count", "l_quantity"))


@query
def agg_multi_col(t):
    return aggregate(t.lineitem, q=("sum", "l_quantity"), t=("max", "l_tax"), d=("min", "l_shipdate"), n=("count", "*"))


@query
def agg_filtered(t):
    return aggregate(t.orders.filter(compare("o_orderstatus", "=", "F")), mx=("max", "o_totalprice"), n=("count", "*"))


@query
def agg_empty_input(t):
    return aggregate(t.orders.filter(compare("o_totalprice", "<", -1)), s=("sum", "o_totalprice"), d=("min", "o_orderdate"), n=("count", "*"))


@query
def agg_text(t):
    return aggregate(t.part, mn=("min", "p_name"), mx=("max", "p_brand"), n=("count", "p_type"))


@query
def agg_distinct(t):
    return aggregate(t.lineitem, flags=F.count_distinct("l_returnflag"), parts=F.count_distinct("l_partkey"))


@query
def agg_conditional(t):
    returned = F.col("l_returnflag") == "R"
    return aggregate(t.lineitem, n=F.count_if(returned), mx=F.max(F.when(returned, F.col("l_quantity"))))


@query
def group_by_flags(t):
    return group(t.lineitem, ["l_returnflag", "l_linestatus"], sum_qty=("sum", "l_quantity"), sum_price=exact_sum("l_extendedprice"), avg_qty=F.round(F.avg("l_quantity"), 6), n=("count", "*"))


@query
def group_by_having(t):
    return group(t.orders, ["o_custkey"], having=compare("n", ">", 12), n=("count", "*"), mx=("max", "o_totalprice"))


@query
def group_by_rollup(t):
    return group(t.customer, ["c_nationkey", "c_mktsegment"], grouping="rollup", n=("count", "*"), mn=("min", "c_acctbal"))


@query
def group_by_cube(t):
    return group(t.lineitem, ["l_returnflag", "l_linestatus"], grouping="cube", n=("count", "*"), mx=("max", "l_shipdate"))


@query
def distinct_rows(t):
    return distinct(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity")


def on(left: str, op: str, right: str) -> Column:
    return compare(left, op, F.col(right))


@query
def join_equi_num(t):
    return join(t.orders, t.customer, on("o_custkey", "=", "c_custkey")).select("o_orderkey", "c_name")


@query
def join_equi_str(t):
    s = t.supplier.select("s_suppkey", F.concat(F.lit("Supplier-"), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("k"))
    p = t.part.select("p_partkey", F.concat(F.lit(" Supplier-"), F.col("p_size").cast("string")).alias("k"))
    return join_groups(s.withColumn("k", trimmed("k")), p.withColumn("k", trimmed("k")), "k").select("s_suppkey", "p_partkey")


@query
def join_equi_date(t):
    shipped = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("day"))
    return join_groups(shipped, t.orders.select("o_orderkey", F.col("o_orderdate").alias("day")), "day").select("l_orderkey", "l_linenumber", "o_orderkey")


@query
def join_multi_cond(t):
    return join(t.lineitem, t.orders, on("l_orderkey", "=", "o_orderkey"), on("l_shipdate", ">=", "o_orderdate")).select("l_orderkey", "l_linenumber")


@query
def join_eq_and_ne(t):
    c = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nationkey"))
    s = t.supplier.select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nationkey"))
    return join_groups(c, s, "nationkey", on("c_acctbal", "<>", "s_acctbal")).select("c_custkey", "s_suppkey")


@query
def join_theta_lt(t):
    return join_ordered(t.customer.select("c_custkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_acctbal"), "c_acctbal", "<", "s_acctbal").select("c_custkey", "s_suppkey")


@query
def join_theta_gt(t):
    return join_ordered(t.customer.select("c_custkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_acctbal"), "c_acctbal", ">", "s_acctbal").select("c_custkey", "s_suppkey")


@query
def join_theta_le(t):
    return join(t.customer, t.nation, on("c_nationkey", "<=", "n_nationkey")).select("c_custkey", "n_nationkey")


@query
def join_theta_ge(t):
    return join(t.customer, t.nation, on("c_nationkey", ">=", "n_nationkey")).select("c_custkey", "n_nationkey")


@query
def join_theta_ne(t):
    return join(t.nation, t.region, on("n_regionkey", "<>", "r_regionkey")).select("n_nationkey", "r_regionkey")


@query
def join_or_condition(t):
    return join_either(t.nation, t.supplier, on("n_nationkey", "=", "s_nationkey"), on("n_regionkey", ">", "s_suppkey")).select("n_nationkey", "s_suppkey")


@query
def join_three_way(t):
    buyers = t.customer.filter(compare("c_mktsegment", "=", "BUILDING"))
    return join_all(buyers, (t.orders, on("c_custkey", "=", "o_custkey")), (t.lineitem, on("o_orderkey", "=", "l_orderkey"))).select("c_custkey", "o_orderkey", "l_linenumber")


@query
def join_self(t):
    both = join(t.nation.alias("a"), t.nation.alias("b"), on("a.n_regionkey", "=", "b.n_regionkey"), on("a.n_nationkey", "<", "b.n_nationkey"))
    return both.select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query
def join_same_name_cols(t):
    n = t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k")).alias("n")
    r = t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")).alias("r")
    return join(n, r, on("n.k", "=", "r.k")).select(F.col("n.name").alias("nation_name"), F.col("r.name").alias("region_name"))


@query
def join_then_agg(t):
    owing = t.customer.filter(compare("c_acctbal", "<", 0))
    return aggregate(join(t.orders, owing, on("o_custkey", "=", "c_custkey")), n=("count", "*"), mx=("max", "o_totalprice"))


def outer_join(name: str, how: str, *columns: str) -> None:
    """Registers a join of nations with suppliers in debt, of one of the types that are not inner."""
    def run(t: Tables) -> DataFrame:
        owing = t.supplier.filter(compare("s_acctbal", "<", 0))
        return join(t.nation.filter(compare("n_nationkey", "<", 20)), owing, on("n_nationkey", "=", "s_nationkey"), how=how).select(*columns)

    QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))


outer_join("join_left", "left", "n_nationkey", "s_suppkey")
outer_join("join_right", "right", "n_nationkey", "s_suppkey")
outer_join("join_full", "full", "n_nationkey", "s_suppkey")
outer_join("join_semi", "left_semi", "n_nationkey")
outer_join("join_anti", "left_anti", "n_nationkey")


@query
def join_two_keys(t):
    rows = join(t.lineitem, t.orders, on("l_orderkey", "=", "o_orderkey"), on("l_shipdate", "=", "o_orderdate"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query
def join_using_key(t):
    orders = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    return join_using(t.customer.select(F.col("c_custkey").alias("custkey"), "c_name"), orders, "custkey")


@query
def join_range(t):
    """Parts whose price lies in the 5 above a supplier's balance."""
    spans = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return band(t.part, spans, "p_retailprice", "low", "high", 5.0).select("p_partkey", "s_suppkey")


@query
def join_asof(t):
    """Each purchase with the last click of its user before it."""
    clicks = t.events.filter(compare("event_type", "=", "click")).select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    return asof(t.events.filter(compare("event_type", "=", "purchase")).select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "clicked", ["click_id"]).select("event_id", "click_id")


@query
def prefix_sum(t):
    before = exclusive_sum("l_quantity", ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", before.alias("before"))


@query
def sort_nulls_last(t):
    owed = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("owed"))
    return order_by(owed, "owed desc nulls last", "c_custkey")


@query
def sort_expression(t):
    return t.orders.orderBy((F.col("o_totalprice") % 1000).desc(), "o_orderkey").select("o_orderkey")


@query
def top_100(t):
    return top_k(t.lineitem, 100, "l_extendedprice desc", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice")


def sorted_by(name: str, source: str, columns: str, *keys: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: order_by(table(spark, sf_dir, source), *keys).select(*columns.split())


for _way in ("asc", "desc"):
    sorted_by(f"sort_num_{_way}", "customer", "c_custkey c_acctbal", f"c_acctbal {_way}")
    sorted_by(f"sort_str_{_way}", "part", "p_partkey p_name", f"p_name {_way}")
sorted_by("sort_date_asc", "orders", "o_orderkey o_orderdate", "o_orderdate")
sorted_by("sort_date_desc", "events", "event_id ts", "ts desc")
sorted_by("sort_large_num", "lineitem", "l_orderkey l_linenumber l_extendedprice", "l_extendedprice desc")
sorted_by("sort_large_date", "lineitem", "l_orderkey l_linenumber l_shipdate", "l_shipdate")
sorted_by("sort_multi_key", "orders", "o_orderkey o_orderstatus o_totalprice", "o_orderstatus asc", "o_totalprice desc")
sorted_by("sort_unprojected_key", "customer", "c_name", "c_acctbal desc")


@query
def flagship(t):
    dear = t.orders.filter(compare("o_totalprice", ">", 300000))
    rows = join_all(dear, (t.customer, on("o_custkey", "=", "c_custkey")), (t.nation, on("c_nationkey", "=", "n_nationkey")))
    return order_by(rows.select("c_name", "n_name", "o_orderkey", "o_totalprice"), "c_name asc")


def ask(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the tables of a directory that its text names."""
    engine = Engine(spark)
    for name in NAMES:
        if re.search(rf"\b{name}\b", text):
            engine.register(name, table(spark, sf_dir, name))
    return engine.sql(text)


for _name, _text in TEXTS.items():
    QUERIES[_name] = lambda spark, sf_dir, text=_text: ask(spark, sf_dir, text)
