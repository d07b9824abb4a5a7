"""Grouping and every aggregate."""

from polyquery.queries.base import sql

sql("group_basic", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q, round(avg(l_extendedprice), 4) as a, min(l_shipdate) as first_day, max(l_shipdate) as last_day from lineitem group by l_returnflag, l_linestatus")
sql("group_ordinal", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
sql("group_having_alias", "select o_custkey, count(*) as n from orders group by o_custkey having n > 15")
sql("group_none_empty", "select count(*) as n, sum(o_totalprice) as s, max(o_orderkey) as m from orders where o_orderkey < 0")
sql("group_expression", "select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n from orders group by year(o_orderdate), month(o_orderdate)", "select year(o_orderdate)::int as y, month(o_orderdate)::int as m, count(*) as n from orders group by all")
sql("group_first_of_others", "select n_regionkey, min(n_name) as any_name, count(*) as n from nation group by n_regionkey")
sql("group_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
sql("group_cube", "select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus) as g from orders group by cube (o_orderstatus, o_orderpriority)", "select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus)::tinyint as g from orders group by cube (o_orderstatus, o_orderpriority)")
sql("group_sets", "select c_mktsegment, c_nationkey, count(*) as n from customer group by grouping sets ((c_mktsegment), (c_nationkey), ())")
sql("agg_count_forms", "select count(*) as a, count(nullif(n_regionkey, 1)) as b, count(distinct n_regionkey) as c from nation")
sql("agg_sum_types", "select sum(l_linenumber) as i, round(sum(l_quantity), 2) as f, sum(cast(l_quantity as decimal(12,2))) as d from lineitem", "select sum(l_linenumber)::bigint as i, round(sum(l_quantity), 2) as f, sum(l_quantity::decimal(12,2))::decimal(22,2) as d from lineitem")
sql("agg_min_max_text", "select min(c_name) as a, max(c_mktsegment) as b from customer")
sql("agg_total", "select total(case when n_nationkey < 0 then 1 end) as a, total(n_nationkey) as b from nation", "select coalesce(sum(case when n_nationkey < 0 then 1 end), 0)::double as a, sum(n_nationkey)::double as b from nation", "sqlite")
sql("agg_group_concat", "select n_regionkey, group_concat(n_name order by n_name separator ';') as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ';' order by n_name) as names from nation group by n_regionkey", "mysql")
sql("agg_string_agg_distinct", "select n_regionkey, string_agg(distinct left(n_name, 1), ',' order by left(n_name, 1)) as letters from nation group by n_regionkey", dialect="postgres")
sql("agg_listagg", "select c_nationkey, listagg(c_mktsegment, '|') within group (order by c_custkey) as s from customer group by c_nationkey", "select c_nationkey, string_agg(c_mktsegment, '|' order by c_custkey) as s from customer group by c_nationkey", "oracle")
sql("agg_array", "select n_regionkey, array_join(array_sort(array_agg(n_nationkey)), ',') as keys from nation group by n_regionkey", "select n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') as keys from nation group by n_regionkey", "standard")
sql("agg_json_array", "select r_regionkey, json_arrayagg(r_name) as j from region group by r_regionkey", "select r_regionkey, '[\"' || r_name || '\"]' as j from region", "mysql")
sql("agg_json_object", "select r_regionkey, json_objectagg(r_name, r_regionkey) as j from region group by r_regionkey", "select r_regionkey, '{\"' || r_name || '\":' || r_regionkey || '}' as j from region", "mysql")
sql("agg_bool", "select n_regionkey, bool_and(n_nationkey > 1) as a, bool_or(n_nationkey > 20) as b from nation group by n_regionkey")
sql("agg_bits", "select n_regionkey, bit_and(n_nationkey) as a, bit_or(n_nationkey) as o, bit_xor(n_nationkey) as x from nation group by n_regionkey", "select n_regionkey, bit_and(n_nationkey)::bigint as a, bit_or(n_nationkey)::bigint as o, bit_xor(n_nationkey)::bigint as x from nation group by n_regionkey")
sql("agg_any_value", "select r_regionkey, any_value(r_name) as v from region group by r_regionkey")
sql("agg_variance", "select c_nationkey, round(var_pop(c_acctbal), 2) as vp, round(var_samp(c_acctbal), 2) as vs, round(stddev_pop(c_acctbal), 4) as sp, round(stddev_samp(c_acctbal), 4) as ss from customer group by c_nationkey")
sql("agg_variance_dialect", "select round(stddev(c_acctbal), 4) as s, round(variance(c_acctbal), 2) as v from customer", "select round(stddev_pop(c_acctbal), 4) as s, round(var_pop(c_acctbal), 2) as v from customer", "mysql")
sql("agg_cv", "select c_mktsegment, round(cv(c_acctbal), 6) as c from customer group by c_mktsegment", "select c_mktsegment, round(stddev_pop(c_acctbal) / avg(c_acctbal), 6) as c from customer group by c_mktsegment")
sql("agg_median_percentile", "select o_orderpriority, round(median(o_totalprice), 4) as m, round(percentile_cont(0.25) within group (order by o_totalprice), 4) as q, percentile_disc(0.9) within group (order by o_totalprice) as d from orders group by o_orderpriority")
sql("agg_correlation", "select round(corr(l_quantity, l_extendedprice), 8) as c, round(covar_pop(l_quantity, l_extendedprice), 2) as p, round(covar_samp(l_quantity, l_extendedprice), 2) as s from lineitem")
sql("agg_regression", "select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as icpt, round(regr_r2(l_extendedprice, l_quantity), 8) as r2, regr_count(l_extendedprice, l_quantity) as n, round(regr_avgx(l_extendedprice, l_quantity), 6) as ax, round(regr_avgy(l_extendedprice, l_quantity), 4) as ay from lineitem", "select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as icpt, round(regr_r2(l_extendedprice, l_quantity), 8) as r2, regr_count(l_extendedprice, l_quantity)::bigint as n, round(regr_avgx(l_extendedprice, l_quantity), 6) as ax, round(regr_avgy(l_extendedprice, l_quantity), 4) as ay from lineitem")
sql("agg_regression_sums", "select round(regr_sxx(l_tax, l_discount), 6) as sxx, round(regr_syy(l_tax, l_discount), 6) as syy, round(regr_sxy(l_tax, l_discount), 6) as sxy from lineitem")
sql("agg_approx_distinct_exact", "select count(distinct o_custkey) as n from orders")
sql("agg_filter", "select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, round(sum(o_totalprice) filter (where o_orderpriority like '1%'), 2) as urgent from orders group by o_orderstatus")
sql("agg_distinct_sum", "select n_regionkey, sum(distinct n_nationkey % 3) as s from nation group by n_regionkey", "select n_regionkey, sum(distinct n_nationkey % 3)::bigint as s from nation group by n_regionkey")
sql("agg_ratio_to_report", "select n_nationkey, round(n_nationkey / sum(n_nationkey) over (), 8) as r from nation")
sql("agg_stats_null", "select stats_t_test_one(c_acctbal) as t from customer", "select null::double as t", "oracle")
