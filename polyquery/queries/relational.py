"""Scans, projections, filters, joins, set operations, order and limits."""

from polyquery.queries.base import sql

sql("flagship_nation_revenue", """
select * from (
  select n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as revenue,
    rank() over (order by round(sum(o_totalprice), 2) desc) as place
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  where o_orderdate >= timestamp '1995-01-01 00:00:00'
  group by n_name having count(*) > 5) t
order by place, n_name limit 10""")
sql("scan_projection", "select l_orderkey, l_linenumber, l_quantity * l_extendedprice as gross, l_returnflag from lineitem")
sql("scan_star", "select * from nation")
sql("scan_qualified_star", "select c.*, n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey")
sql("scan_no_from", "select 1 as one, 'x' as letter")
sql("scan_derived_table", "select t.k, t.n from (select o_custkey as k, count(*) as n from orders group by o_custkey) t where t.n > 10")
sql("scan_derived_union", "select k, count(*) as n from (select c_nationkey as k from customer union all select s_nationkey as k from supplier) u group by k")
sql("scan_cte", "with big as (select * from orders where o_totalprice > 100000), per as (select o_custkey, count(*) as n from big group by o_custkey) select o_custkey, n from per where n >= 2")
sql("scan_cte_columns", "with c(k, total) as (select o_custkey, round(sum(o_totalprice), 2) from orders group by o_custkey) select k, total from c where total > 500000")
sql("scan_cte_reused", "with t as (select o_custkey as k, max(o_totalprice) as m from orders group by o_custkey) select a.k, a.m from t a join t b on a.k = b.k + 1 and a.m > b.m")
sql("scan_cte_recursive", "with recursive r as (select 1 as i, 1 as f union all select i + 1, f * (i + 1) from r where i < 10) select i, f from r")
sql("scan_cte_materialized", "with t as materialized (select n_regionkey, count(*) as n from nation group by n_regionkey) select * from t")
sql("filter_comparisons", "select o_orderkey, o_totalprice from orders where o_totalprice > 150000 and o_totalprice <= 200000 and o_orderstatus <> 'F'")
sql("filter_or_not", "select c_custkey from customer where not (c_acctbal < 0 or c_mktsegment = 'BUILDING')")
sql("filter_between", "select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 12 and l_discount not between 0.02 and 0.08")
sql("filter_in_list", "select s_suppkey, s_name from supplier where s_nationkey in (1, 3, 5) and s_suppkey not in (2, 4)")
sql("filter_like", "select p_partkey, p_name from part where p_name like '%a%' and p_type not like 'S%'")
sql("filter_is_null", "select count(*) as n from orders left join customer on o_custkey = c_custkey + 100000 where c_custkey is null")
sql("filter_regexp", "select n_name from nation where n_name rlike '^[A-I].*A$'", "select n_name from nation where regexp_matches(n_name, '^[A-I].*A$')")
sql("filter_null_safe_equal", "select count(*) as n from (select nullif(n_regionkey, 1) as a from nation) t where a <=> null", "select count(*) as n from (select nullif(n_regionkey, 1) as a from nation) t where a is not distinct from null")
sql("filter_sounds_like", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_nationkey < b.n_nationkey and left(a.n_name, 1) = left(b.n_name, 1) and length(a.n_name) = length(b.n_name)")
sql("expr_case_searched", "select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as size from orders")
sql("expr_case_simple", "select o_orderstatus, case o_orderstatus when 'F' then 1 when 'O' then 2 end as code, count(*) as n from orders group by o_orderstatus")
sql("expr_arithmetic", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge, -l_quantity as neg from lineitem")
sql("expr_casts", "select p_partkey, cast(p_retailprice as int) as whole, cast(p_size as varchar) as size_text, cast('12' as bigint) as twelve from part where p_retailprice = floor(p_retailprice)")
sql("expr_concat_operator", "select s_suppkey, s_name || '/' || cast(s_nationkey as varchar) as tag from supplier")
sql("expr_row_value_in", "select n_nationkey from nation where (n_regionkey, n_nationkey % 2) in ((1, 0), (2, 1))")
sql("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 300000")
sql("join_three_way", "select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
sql("join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000 group by c_custkey")
sql("join_right", "select n_name, count(s_suppkey) as n from supplier right join nation on s_nationkey = n_nationkey group by n_name")
sql("join_full", "select coalesce(a.k, b.k) as k, a.n as n_c, b.n as n_s from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by c_nationkey) a full join (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 5000 group by s_nationkey) b on a.k = b.k")
sql("join_cross", "select r_name, n_name from region cross join nation")
sql("join_comma", "select r_name, n_name from region, nation where n_regionkey = r_regionkey")
sql("join_theta", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey <> b.n_regionkey")
sql("join_self", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
sql("join_using", "select n_regionkey, n_name, m from nation join (select n_regionkey, max(n_nationkey) as m from nation group by n_regionkey) t using (n_regionkey)")
sql("join_many_to_many", "select l_partkey, count(distinct l_suppkey) as n from lineitem join part on l_partkey = p_partkey where p_size < 5 group by l_partkey")
sql("join_left_is_null", "select c_custkey from customer left join orders on c_custkey = o_custkey where o_orderkey is null")
sql("set_union_all", "select n_name as x from nation union all select r_name as x from region")
sql("set_union", "select n_regionkey as x from nation union select r_regionkey as x from region")
sql("set_mixed_union", "select 1 as x union all select 1 as x union select 2 as x")
sql("set_intersect", "select c_nationkey as k from customer intersect select s_nationkey as k from supplier")
sql("set_except", "select n_nationkey as k from nation except select s_nationkey as k from supplier")
sql("distinct_rows", "select distinct l_returnflag, l_linestatus from lineitem")
sql("distinct_on", "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey", dialect="postgres")
sql("order_nulls", "select k, row_number() over (order by k desc nulls first, n) as place from (select nullif(n_regionkey, 2) as k, n_nationkey as n from nation) t")
sql("order_ordinal_limit", "select c_name, c_acctbal from customer order by 2 desc, 1 limit 7")
sql("limit_offset", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10 offset 25")
sql("top_k_per_group", "select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rn from customer) t where rn <= 3")
sql("distinct_on_limit", "select distinct on (o_custkey) o_custkey, o_orderkey from orders order by o_custkey, o_totalprice desc, o_orderkey limit 5", dialect="postgres")
