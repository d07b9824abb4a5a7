"""Subqueries and lateral joins."""

from polyquery.queries.base import sql

sql("sub_scalar", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 2 from orders)")
sql("sub_scalar_select", "select n_name, (select count(*) from customer where c_nationkey = n_nationkey) as n from nation")
sql("sub_correlated_max", "select o_orderkey, o_custkey from orders o where o_totalprice = (select max(o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
sql("sub_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
sql("sub_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
sql("sub_exists_inequality", "select a.o_orderkey from orders a where exists (select 1 from orders b where b.o_custkey = a.o_custkey and b.o_orderdate > a.o_orderdate and b.o_totalprice > a.o_totalprice)")
sql("sub_in", "select count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_size = 1)")
sql("sub_not_in", "select n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)")
sql("sub_not_in_null", "select n_name from nation where n_nationkey not in (select nullif(s_nationkey, 3) from supplier)")
sql("sub_row_in", "select s_suppkey from supplier where (s_nationkey, s_suppkey) in (select c_nationkey, min(c_custkey) from customer group by c_nationkey)")
sql("sub_any", "select c_custkey from customer where c_acctbal > any (select s_acctbal from supplier where s_nationkey = 7)", "select c_custkey from customer where exists (select 1 from supplier where s_nationkey = 7 and c_acctbal > s_acctbal)", "postgres")
sql("sub_all", "select c_custkey from customer where c_acctbal >= all (select s_acctbal from supplier where s_nationkey = 7)", "select c_custkey from customer where not exists (select 1 from supplier where s_nationkey = 7 and not coalesce(c_acctbal >= s_acctbal, false))", "postgres")
sql("sub_all_empty", "select count(*) as n from nation where n_nationkey > all (select s_suppkey from supplier where s_suppkey < 0)", "select count(*) as n from nation", "postgres")
sql("sub_count_compare", "select c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey) > 20")
sql("sub_in_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) >= (select max(n) - 2 from (select count(*) as n from orders group by o_custkey) t)")
sql("lateral_join", "select n_name, t.c_custkey from nation, lateral (select c_custkey, c_acctbal from customer where c_nationkey = n_nationkey order by c_acctbal desc, c_custkey limit 2) t")
sql("cross_apply", "select n.n_name, t.s from nation n cross apply (select sum(c.c_custkey) as s from customer c where c.c_nationkey = n.n_nationkey) t", "select n_name, t.s::bigint as s from nation, lateral (select sum(c_custkey) as s from customer where c_nationkey = n_nationkey) t", "sqlserver")
sql("outer_apply", "select n.n_name, t.s_suppkey from nation n outer apply (select top 1 s.s_suppkey, s.s_acctbal from supplier s where s.s_nationkey = n.n_nationkey and s.s_acctbal > 8000 order by s.s_acctbal desc) t", "select n_name, t.s_suppkey from nation left join lateral (select s_suppkey from supplier where s_nationkey = n_nationkey and s_acctbal > 8000 order by s_acctbal desc limit 1) t on true", "sqlserver")
sql("sub_equal_any", "select n_name from nation where n_nationkey = any (select s_nationkey from supplier where s_acctbal > 8000)", "select n_name from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 8000)", "postgres")
sql("sub_unequal_all", "select n_name from nation where n_nationkey <> all (select s_nationkey from supplier where s_acctbal > 8000)", "select n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 8000)", "postgres")
sql("sub_all_null", "select count(*) as n from nation where n_nationkey > all (select nullif(s_suppkey, 1) - 100000 from supplier)", "select 0::bigint as n", "postgres")
sql("sub_less_any", "select c_custkey from customer where c_acctbal < any (select s_acctbal from supplier where s_nationkey = 9)", "select c_custkey from customer where c_acctbal < (select max(s_acctbal) from supplier where s_nationkey = 9)", "postgres")
sql("sub_any_expression", "select n_nationkey from nation where n_regionkey = 1 or 2 * n_nationkey + 1 = any (select s_nationkey from supplier where s_acctbal > 5000)", "select n_nationkey from nation where n_regionkey = 1 or 2 * n_nationkey + 1 in (select s_nationkey from supplier where s_acctbal > 5000)", "postgres")
