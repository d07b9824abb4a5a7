"""Queries whose feature needs no filter run over all rows of their tables."""

import __spark_entry__ as entry


def test_rows_of_higher_ids_count(spark, tmp_path):
    spark.sql("select 700L as event_id, '{\"a\": 1, \"b\": \"x\"}' as props").write.parquet(str(tmp_path / "events.parquet"))
    spark.sql("select id + 5000 as o_orderkey, 7L as o_custkey, timestamp'2020-01-01 10:00:00' + make_interval(0, 0, 0, int(id)) as o_orderdate, 10.0D + id as o_totalprice from range(3)").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("select id + 900 as c_custkey, 3L as c_nationkey, concat('m', id) as c_mktsegment, 100.0D + id as c_acctbal from range(2)").write.parquet(str(tmp_path / "customer.parquet"))
    spark.sql("select 1L as p_partkey, 99.0D as p_retailprice").write.parquet(str(tmp_path / "part.parquet"))

    def run(name):
        return sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())

    assert [r[:2] for r in run("json_each")] == [(700, "a"), (700, "b")]
    assert run("sub_exists_inequality") == [(5000,), (5001,)]
    assert run("agg_listagg") == [(3, "m0|m1")]
    assert [r[:2] for r in run("fn_conv_to_char")] == [(5000, "2020-01-01 10:00"), (5001, "2020-01-02 10:00"), (5002, "2020-01-03 10:00")]
    assert run("frame_range_join") == [(900, 1), (901, 1)]
    for name in ("json_each", "sub_exists_inequality", "agg_listagg", "fn_conv_to_char", "frame_range_join"):
        assert "key < " not in entry.oracle_sql()[name] and "event_id < " not in entry.oracle_sql()[name]
