"""Operators of the DataFrame API."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from polyquery.operators import relational as R
from polyquery.operators import windows as W
from polyquery.queries.base import frame
from polyquery.streaming import windows as S


@frame("frame_groups", "select n_nationkey, count(*) over w as n, (sum(n_nationkey) over w)::bigint as s from nation window w as (order by n_regionkey groups between 1 preceding and current row)")
def groups(load, spark):
    out = W.groups_frame(load("nation"), [], ["n_regionkey"], -1, 0, n=F.count("*"), s=F.sum("n_nationkey"))
    return out.select("n_nationkey", "n", "s")


@frame("frame_groups_partitioned", "select o_orderkey, round(max(o_totalprice) over (partition by o_custkey order by o_orderpriority groups between unbounded preceding and 1 preceding), 2) as m from orders")
def groups_partitioned(load, spark):
    return W.groups_frame(load("orders"), ["o_custkey"], ["o_orderpriority"], None, -1, m=F.max("o_totalprice")).select("o_orderkey", F.round("m", 2).alias("m"))


@frame("frame_ntile_compat", "select n_nationkey, floor((row_number() over (order by n_nationkey) - 1) * 4.0 / count(*) over ())::bigint + 1 as b from nation")
def ntile_compat(load, spark):
    return load("nation").select("n_nationkey", W.ntile_by_share(4, [], ["n_nationkey"]).alias("b"))


@frame("frame_distinct_on", "select distinct on (s_nationkey) s_nationkey, s_suppkey, s_acctbal from supplier order by s_nationkey, s_acctbal desc, s_suppkey")
def distinct_on(load, spark):
    return R.distinct_on(load("supplier"), ["s_nationkey"], [F.desc("s_acctbal"), "s_suppkey"]).select("s_nationkey", "s_suppkey", "s_acctbal")


@frame("frame_count_distinct_over", "select o_orderkey, len(list_distinct(list(o_orderstatus) over (partition by o_custkey)))::int as n from orders")
def count_distinct_over(load, spark):
    return load("orders").select("o_orderkey", W.count_distinct_over("o_orderstatus", Window.partitionBy("o_custkey")).alias("n"))


@frame("frame_pivot_count", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'X') as \"X\" from orders group by 1")
def pivot_count(load, spark):
    return R.pivot_count(load("orders"), "o_orderstatus", ["F", "O", "X"], "o_orderpriority")


@frame("frame_unpivot", "select n_nationkey, 'region' as k, n_regionkey as v from nation union all select n_nationkey, 'odd', nullif(n_nationkey % 2, 0) from nation where n_nationkey % 2 = 1")
def unpivot(load, spark):
    df = load("nation").selectExpr("n_nationkey", "n_regionkey as region", "nullif(n_nationkey % 2, 0) as odd")
    return R.unpivot(df, ["n_nationkey"], ["region", "odd"], "k", "v")


@frame("frame_range_join", "select c_custkey, p_partkey from customer join part on c_acctbal >= p_retailprice and c_acctbal < p_retailprice + 5")
def range_join(load, spark):
    parts = load("part").selectExpr("p_partkey", "p_retailprice as low", "p_retailprice + 5 as high")
    return R.range_join(load("customer"), parts, "c_acctbal", "low", "high", 50.0).select("c_custkey", "p_partkey")


@frame("frame_as_of_join", "select e.event_id, o.o_orderkey from events e asof left join (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey from orders group by all) o on e.user_id = o.o_custkey and e.ts >= o.o_orderdate")
def as_of_join(load, spark):
    orders = load("orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey")).withColumnRenamed("o_custkey", "user_id")
    return R.as_of_join(load("events").select("event_id", "user_id", "ts"), orders, ["user_id"], "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


@frame("frame_two_valued_not", "select n_nationkey from nation where not coalesce(nullif(n_regionkey, 1) = 2, false)")
def two_valued(load, spark):
    return load("nation").where(~R.two_valued("nullif(n_regionkey, 1) = 2")).select("n_nationkey")


@frame("frame_for_json", "select '{\"rows\":[{\"r_regionkey\":0}]}' as json")
def for_json(load, spark):
    return R.for_json(load("region").where("r_regionkey = 0").select("r_regionkey"), "rows")


@frame("stream_tumbling", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def tumbling(load, spark):
    return S.tumbling(load("events")).withColumn("total", F.round("total", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@frame("stream_sessions", "select user_id, min(ts) as start, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events)) group by user_id, s")
def sessions(load, spark):
    return S.sessions(load("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@frame("stream_deduplicate", "select count(distinct event_id) as n from events")
def deduplicate(load, spark):
    both = load("events").unionAll(load("events"))
    return S.deduplicate(both).agg(F.count("*").alias("n"))
