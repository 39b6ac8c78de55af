"""SQL of each registered query, for an independent engine over the same tables."""

SQL = {
    "scan_all": 'select * from orders',
    "project_reorder": 'select o_totalprice, o_orderkey, o_orderdate from orders',
    "filter_num_eq": 'select l_orderkey, l_linenumber from lineitem where l_quantity = 10',
    "filter_num_ne": 'select l_orderkey, l_linenumber from lineitem where l_quantity <> 10',
    "filter_num_lt": 'select l_orderkey, l_linenumber from lineitem where l_quantity < 10',
    "filter_num_le": 'select l_orderkey, l_linenumber from lineitem where l_quantity <= 10',
    "filter_num_gt": 'select l_orderkey, l_linenumber from lineitem where l_quantity > 40',
    "filter_num_ge": 'select l_orderkey, l_linenumber from lineitem where l_quantity >= 40',
    "filter_str_eq": "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'",
    "filter_str_ne": "select c_custkey, c_name from customer where c_mktsegment <> 'BUILDING'",
    "filter_str_range": "select c_custkey, c_mktsegment from customer where c_mktsegment >= 'F' and c_mktsegment < 'N'",
    "filter_date_eq": "select o_orderkey from orders where o_orderdate = timestamp '1998-10-03 00:00:00'",
    "filter_date_ne": "select o_orderkey from orders where o_orderdate <> timestamp '1998-10-03 00:00:00'",
    "filter_date_range": "select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1997-01-01 00:00:00' and o_orderdate < timestamp '1998-01-01 00:00:00'",
    "filter_date_time_of_day": "select event_id, ts from events where ts > timestamp '2024-01-10 12:30:45'",
    "filter_and_multi_col": "select o_orderkey from orders where o_totalprice > 200000 and o_orderstatus = 'F' and o_orderdate < timestamp '1998-01-01 00:00:00'",
    "filter_or": "select c_custkey, c_acctbal, c_mktsegment from customer where c_acctbal > 9000 or c_mktsegment = 'MACHINERY'",
    "filter_or_same_col": 'select c_custkey, c_acctbal from customer where c_acctbal > 9000 or c_acctbal < 0',
    "filter_nested_bool": "select o_orderkey from orders where (o_totalprice > 400000 and o_orderstatus = 'O') or (o_totalprice < 2000 and o_orderstatus = 'F')",
    "filter_col_vs_col": 'select l_orderkey, l_linenumber from lineitem where l_tax > l_discount',
    "agg_sum": 'select cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_price from lineitem',
    "agg_avg": 'select round(avg(l_quantity), 6) as avg_qty from lineitem',
    "agg_min_max_num": 'select min(c_acctbal) as mn, max(c_acctbal) as mx from customer',
    "agg_min_max_date": 'select min(o_orderdate) as mn, max(o_orderdate) as mx from orders',
    "agg_count_star": 'select count(*) as n from lineitem',
    "agg_count_col": 'select count(o_orderdate) as n from orders',
    "agg_same_col_all": 'select sum(l_quantity) as s, round(avg(l_quantity),6) as a, min(l_quantity) as mn, max(l_quantity) as mx, count(l_quantity) as n from lineitem',
    "agg_multi_col": 'select sum(l_quantity) as q, max(l_tax) as t, min(l_shipdate) as d, count(*) as n from lineitem',
    "agg_filtered": "select max(o_totalprice) as mx, count(*) as n from orders where o_orderstatus = 'F'",
    "agg_empty_input": 'select sum(o_totalprice) as s, min(o_orderdate) as d, count(*) as n from orders where o_totalprice < -1',
    "join_equi_num": 'select o.o_orderkey, c.c_name from orders o, customer c where o.o_custkey = c.c_custkey',
    "join_equi_str": "select s.s_suppkey, p.p_partkey from (select s_suppkey, concat('Supplier-', s_nationkey, ' ') as k from supplier) s, (select p_partkey, concat(' Supplier-', p_size) as k from part) p where trim(s.k) = trim(p.k)",
    "join_equi_date": 'select l.l_orderkey, l.l_linenumber, o.o_orderkey from lineitem l, orders o where l.l_shipdate = o.o_orderdate',
    "join_multi_cond": 'select l.l_orderkey, l.l_linenumber from lineitem l, orders o where l.l_orderkey = o.o_orderkey and l.l_shipdate >= o.o_orderdate',
    "join_eq_and_ne": 'select c.c_custkey, s.s_suppkey from customer c, supplier s where c.c_nationkey = s.s_nationkey and c.c_acctbal <> s.s_acctbal',
    "join_theta_lt": 'select c.c_custkey, s.s_suppkey from customer c, supplier s where c.c_acctbal < s.s_acctbal',
    "join_theta_le": 'select c.c_custkey, n.n_nationkey from customer c, nation n where c.c_nationkey <= n.n_nationkey',
    "join_theta_gt": 'select c.c_custkey, s.s_suppkey from customer c, supplier s where c.c_acctbal > s.s_acctbal',
    "join_theta_ge": 'select c.c_custkey, n.n_nationkey from customer c, nation n where c.c_nationkey >= n.n_nationkey',
    "join_theta_ne": 'select n.n_nationkey, r.r_regionkey from nation n, region r where n.n_regionkey <> r.r_regionkey',
    "join_or_condition": 'select n.n_nationkey, s.s_suppkey from nation n, supplier s where n.n_nationkey = s.s_nationkey or n.n_regionkey > s.s_suppkey',
    "join_three_way": "select c.c_custkey, o.o_orderkey, l.l_linenumber from customer c, orders o, lineitem l where c.c_custkey = o.o_custkey and o.o_orderkey = l.l_orderkey and c.c_mktsegment = 'BUILDING'",
    "join_self": 'select a.n_name as a_name, b.n_name as b_name from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey',
    "join_same_name_cols": 'select n.name as nation_name, r.name as region_name from (select n_name as name, n_regionkey as k from nation) n, (select r_name as name, r_regionkey as k from region) r where n.k = r.k',
    "join_then_agg": 'select count(*) as n, max(o.o_totalprice) as mx from orders o, customer c where o.o_custkey = c.c_custkey and c.c_acctbal < 0',
    "sort_num_asc": 'select c_custkey, c_acctbal from customer order by c_acctbal asc',
    "sort_num_desc": 'select c_custkey, c_acctbal from customer order by c_acctbal desc',
    "sort_str_asc": 'select p_partkey, p_name from part order by p_name asc',
    "sort_str_desc": 'select p_partkey, p_name from part order by p_name desc',
    "sort_date_asc": 'select o_orderkey, o_orderdate from orders order by o_orderdate asc',
    "sort_date_desc": 'select event_id, ts from events order by ts desc',
    "sort_multi_key": 'select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderstatus asc, o_totalprice desc',
    "sort_unprojected_key": 'select c_name from customer order by c_acctbal desc',
    "flagship": 'select c.c_name, n.n_name, o.o_orderkey, o.o_totalprice from customer c, nation n, orders o where c.c_nationkey = n.n_nationkey and o.o_custkey = c.c_custkey and o.o_totalprice > 300000 order by c.c_name asc',
    "filter_in": "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')",
    "filter_like": "select p_partkey, p_name from part where p_name like '%1_'",
    "filter_between": "select p_partkey, p_retailprice from part where p_retailprice between 950 and 1000",
    "filter_is_null": "select c_custkey from customer left join orders on c_custkey = o_custkey where o_orderkey is null",
    "filter_not_null": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey where o_orderkey is not null",
    "agg_text": "select min(p_name) as mn, max(p_brand) as mx, count(p_type) as n from part",
    "agg_distinct": "select count(distinct l_returnflag) as flags, count(distinct l_partkey) as parts from lineitem",
    "agg_conditional": "select count(*) filter (l_returnflag = 'R') as n, max(l_quantity) filter (l_returnflag = 'R') as mx from lineitem",
    "group_by_flags": "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_price, round(avg(l_quantity), 6) as avg_qty, count(*) as n from lineitem group by all",
    "group_by_having": "select o_custkey, count(*) as n, max(o_totalprice) as mx from orders group by o_custkey having count(*) > 12",
    "group_by_rollup": "select c_nationkey, c_mktsegment, count(*) as n, min(c_acctbal) as mn from customer group by rollup (c_nationkey, c_mktsegment)",
    "group_by_cube": "select l_returnflag, l_linestatus, count(*) as n, max(l_shipdate) as mx from lineitem group by cube (l_returnflag, l_linestatus)",
    "distinct_rows": "select distinct l_returnflag, l_linestatus, l_quantity from lineitem",
    "join_left": "select n_nationkey, s_suppkey from (select * from nation where n_nationkey < 20) left join (select * from supplier where s_acctbal < 0) on n_nationkey = s_nationkey",
    "join_right": "select n_nationkey, s_suppkey from (select * from nation where n_nationkey < 20) right join (select * from supplier where s_acctbal < 0) on n_nationkey = s_nationkey",
    "join_full": "select n_nationkey, s_suppkey from (select * from nation where n_nationkey < 20) full join (select * from supplier where s_acctbal < 0) on n_nationkey = s_nationkey",
    "join_semi": "select n_nationkey from nation where n_nationkey < 20 and n_nationkey in (select s_nationkey from supplier where s_acctbal < 0)",
    "join_anti": "select n_nationkey from nation where n_nationkey < 20 and n_nationkey not in (select s_nationkey from supplier where s_acctbal < 0)",
    "join_two_keys": "select l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderkey, o_custkey, o_orderstatus, o_orderdate from lineitem, orders where l_orderkey = o_orderkey and l_shipdate = o_orderdate",
    "join_using_key": "select custkey, c_name, o_orderkey from (select c_custkey as custkey, c_name from customer) join (select o_custkey as custkey, o_orderkey from orders) using (custkey)",
    "join_range": "select p_partkey, s_suppkey from part, supplier where p_retailprice >= s_acctbal and p_retailprice <= s_acctbal + 5",
    "join_asof": "select p.event_id, c.event_id as click_id from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts",
    "prefix_sum": "select l_orderkey, l_linenumber, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and 1 preceding), 0) as before from lineitem",
    "sort_nulls_last": "select c_custkey, case when c_acctbal >= 0 then c_acctbal end as owed from customer order by owed desc nulls last, c_custkey",
    "sort_expression": "select o_orderkey from orders order by o_totalprice % 1000 desc, o_orderkey",
    "sort_large_num": "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc",
    "sort_large_date": "select l_orderkey, l_linenumber, l_shipdate from lineitem order by l_shipdate",
    "top_100": "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100",
}

#: Queries that are asked as SQL; both engines get the same text.
TEXTS = {
    "sql_comma_join": "select c.c_name, n.n_name, o.o_orderkey from customer c, nation n, orders o where c.c_nationkey = n.n_nationkey and o.o_custkey = c.c_custkey and o.o_totalprice > 300000",
    "sql_with": "with spent as (select o_custkey, max(o_totalprice) as top from orders group by o_custkey), rich as (select * from spent where top > 400000) select c_name, top from rich join customer on c_custkey = o_custkey",
    "sql_exists": "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F') and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 450000)",
    "sql_scalar_subquery": "select p_partkey, p_retailprice from part where p_retailprice > (select avg(p_retailprice) from part)",
    "sql_correlated": "select o_orderkey from orders o where o_totalprice = (select max(o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "sql_window": "select o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc) as bigint) as place, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders",
    "sql_union": "select c_nationkey as k from customer where c_acctbal < 0 union select s_nationkey from supplier union all select r_regionkey from region",
    "sql_except": "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 0",
    "sql_intersect": "select c_nationkey as k from customer where c_acctbal < -900 intersect select s_nationkey from supplier where s_acctbal > 5000",
    "sql_grouping_sets": "select c_nationkey, c_mktsegment, count(*) as n from customer group by grouping sets ((c_nationkey), (c_mktsegment), ())",
    "sql_scalar_functions": "select o_orderkey, upper(o_orderpriority) as p, substring(o_orderpriority, 1, 3) as s, length(o_orderpriority) as n, coalesce(nullif(o_orderstatus, 'O'), 'open') as status, cast(floor(o_totalprice / 1000) as bigint) as thousands, case when o_totalprice > 250000 then 'dear' else 'cheap' end as class, cast(extract(year from o_orderdate) as bigint) as y from orders",
    "sql_aliases": "select q.k as nation_key, q.n as customers from (select c_nationkey as k, count(*) as n from customer group by c_nationkey) as q where q.n > 50 order by q.n desc, q.k",
    "sql_limit_offset": "select event_id, ts from events order by ts, event_id limit 50 offset 25",
}
SQL |= TEXTS
