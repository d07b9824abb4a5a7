"""Window functions and frames."""

from polyquery.queries.base import sql

W = "partition by c_nationkey order by c_acctbal desc, c_custkey"
sql("win_row_number", f"select c_custkey, row_number() over ({W}) as rn from customer")
sql("win_ranks", "select o_orderkey, rank() over (order by o_orderpriority) as r, dense_rank() over (order by o_orderpriority) as d from orders")
sql("win_percent_cume", "select n_nationkey, round(percent_rank() over (order by n_regionkey), 8) as p, round(cume_dist() over (order by n_regionkey), 8) as c from nation")
sql("win_ntile", f"select c_custkey, ntile(4) over ({W}) as q from customer")
sql("win_lag_lead", "select event_id, lag(value, 2, 0.0) over (partition by user_id order by ts, event_id) as before, lead(value) over (partition by user_id order by ts, event_id) as after from events")
sql("win_first_last", f"select c_custkey, first_value(c_custkey) over ({W}) as f, last_value(c_custkey) over ({W} rows between unbounded preceding and unbounded following) as l from customer")
sql("win_nth", f"select c_custkey, nth_value(c_custkey, 3) over ({W} rows between unbounded preceding and unbounded following) as x from customer")
sql("win_running_sum", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey), 2) as s, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders")
sql("win_rows_frame", "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 1 following), 6) as a, min(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding) as m from events")
sql("win_range_frame", "select c_custkey, count(*) over (partition by c_nationkey order by c_acctbal range between 500 preceding and 500 following) as n from customer")
sql("win_range_interval", "select event_id, count(*) over (partition by user_id order by ts range between interval '1' hour preceding and current row) as n from events")
sql("win_default_frame_peers", "select n_nationkey, sum(n_nationkey) over (order by n_regionkey) as s from nation", "select n_nationkey, (sum(n_nationkey) over (order by n_regionkey))::bigint as s from nation")
sql("win_whole_partition", "select s_suppkey, max(s_acctbal) over (partition by s_nationkey) as m, count(*) over () as n from supplier")
sql("win_count_distinct", "select o_orderkey, count(distinct o_orderpriority) over (partition by o_custkey) as n from orders", "select o_orderkey, len(list_distinct(list(o_orderpriority) over (partition by o_custkey)))::int as n from orders", "sqlserver")
sql("win_over_group", "select o_orderstatus, count(*) as n, rank() over (order by count(*) desc) as r from orders group by o_orderstatus")
sql("win_named", "select n_nationkey, row_number() over w as a, count(*) over w as b from nation window w as (partition by n_regionkey order by n_name)")
sql("win_stat_aggregates", "select c_custkey, round(stddev_pop(c_acctbal) over (partition by c_nationkey), 4) as s, round(var_samp(c_acctbal) over (partition by c_mktsegment), 2) as v from customer")
sql("win_ignore_nulls", "select n_nationkey, last_value(x) ignore nulls over (order by n_nationkey) as l from (select n_nationkey, case when n_nationkey % 3 = 0 then n_nationkey end as x from nation) t", "select n_nationkey, last_value(x ignore nulls) over (order by n_nationkey) as l from (select n_nationkey, case when n_nationkey % 3 = 0 then n_nationkey end as x from nation) t")
sql("win_groups_frame", "select n_nationkey, count(*) over (order by n_regionkey groups between 1 preceding and current row) as n, count(*) over (partition by n_regionkey order by n_name groups 2 preceding) as m from nation where n_nationkey > 2")
