"""Operators, sources, streams, diagnostics and the entry module."""

import importlib
import random
import sys

import pytest
from pyspark.sql import functions as F

from polyquery.operators import relational as R
from polyquery.operators import windows as W
from polyquery.plans import diagnostics as D
from polyquery.plans.engine import Engine
from polyquery.sources import io
from polyquery.streaming import windows as S


def test_groups_frame(spark):
    rows = [(random.Random(i).randrange(4), i) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r.v: r.s for r in W.groups_frame(df, [], ["k"], -1, 1, s=F.sum("v")).collect()}
    ranks = {k: i for i, k in enumerate(sorted({k for k, _ in rows}))}
    assert got == {v: sum(b for a, b in rows if abs(ranks[a] - ranks[k]) <= 1) for k, v in rows}


def test_as_of_and_range_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, at int, v string")
    got = {(r.k, r.t): r.v for r in R.as_of_join(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}
    points = spark.createDataFrame([(float(i),) for i in range(20)], "p double")
    spans = spark.createDataFrame([(1.0, 4.0), (3.5, 12.0)], "lo double, hi double")
    assert R.range_join(points, spans, "p", "lo", "hi", 3.0).count() == 3 + 8


def test_two_valued_logic(spark):
    df = spark.sql("select * from values (1), (null) as t(a)")
    assert df.where(~R.two_valued("a = 1")).count() == 1


def test_engine_found_rows_and_parameters(spark):
    e = Engine(spark, "mysql").table("pq_t", spark.range(10).toDF("id"))
    assert e.sql("SELECT SQL_CALC_FOUND_ROWS id FROM pq_t WHERE id > 3 LIMIT 2").count() == 2
    assert e.found_rows() == 6
    assert e.sql("SELECT id FROM pq_t WHERE id = :k", {"k": 4}).count() == 1


def test_csv(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("id,name\n1,John\n2,Jane\n")
    df = io.read_csv(spark, str(path), "id int, name string")
    assert io.append_csv(spark, str(path), df).count() == 4
    io.write(df, str(tmp_path / "out"), by=["id"])
    assert io.read(spark, str(tmp_path / "out")).where("id = 2").first()["name"] == "Jane"
    assert io.seed(spark, [(1, "x")], "a int, b string").first()["b"] == "x"


def test_stream(spark, tmp_path):
    events = spark.sql("select id as event_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int) * 10) as ts, id % 3 as user_id, 'e' as event_type, 1.0D as value from range(40)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = S.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("pq_stream").start()
    try:
        q.processAllAvailable()
        assert spark.table("pq_stream").agg(F.sum("n")).first()[0] == 40
    finally:
        q.stop()
    assert S.tumbling(events).count() == 7


def test_plan_warnings():
    codes = lambda sql, r, o: [w.code for w in D.warnings(sql, r, o)]
    assert codes("select * from t order by a", 500, 500) == ["PW001", "PW003", "PW004"]
    assert codes("select distinct a from t where b = 1", 500, 400) == ["PW002", "PW005"]
    assert codes("select a from t where b = 1 order by a limit 1", 500, 3) == []
    assert D.advice("select a from t where b = 1 and (c > 2 or d in (1))") == ["b", "c", "d"]


def test_trace_and_explain(spark):
    df, seen = D.traced(spark.range(7).where("id > 1"), "t")
    df.collect()
    assert seen.get["rows_out"] == 5
    assert "Filter" in D.explain(spark.range(7).where("id > 1"))


def test_scan_pushes_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as b", "id as c").write.parquet(str(tmp_path / "p"))
    plan = D.explain(Engine(spark, "sqlserver").table("pq_p", spark.read.parquet(str(tmp_path / "p"))).sql("SELECT b FROM pq_p WHERE id > 90"))
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,90)]" in plan
    assert "ReadSchema: struct<id:bigint,b:bigint>" in plan


def test_entry_without_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    full = set(entry.queries())
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("polyquery.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    rest = set(again.queries())
    assert rest and rest <= full and not any(n.startswith("op") and n[2].isdigit() for n in rest)
    assert set(again.oracle_sql()) <= rest
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", ["flagship_nation_revenue", "win_count_distinct", "openjson", "dml_upsert", "frame_groups"])
def test_registered_queries_run(spark, name, tmp_path):
    import __spark_entry__ as entry

    from polyquery.queries.base import TABLES

    schema = {
        "nation": "select cast(id as int) as n_nationkey, concat('N', id) as n_name, cast(id % 5 as int) as n_regionkey from range(25)",
        "supplier": "select cast(id as int) as s_suppkey, concat('S', id) as s_name, cast(id % 25 as int) as s_nationkey, cast(id * 10 as double) as s_acctbal from range(50)",
        "customer": "select id as c_custkey, concat('C', id) as c_name, cast(id % 25 as int) as c_nationkey, 1.0D as c_acctbal, 'B' as c_mktsegment from range(50)",
        "orders": "select id as o_orderkey, id % 50 as o_custkey, 'F' as o_orderstatus, 1.5D as o_totalprice, timestamp'1996-01-01' as o_orderdate, '1-URGENT' as o_orderpriority from range(400)",
        "events": "select id as event_id, timestamp'2024-01-01' as ts, 1L as user_id, 'x' as event_type, 1.0D as value, '{\"k\":1,\"s\":\"t\"}' as props from range(10)",
    }
    for t, q in schema.items():
        assert t in TABLES
        spark.sql(q).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert entry.queries()[name](spark, str(tmp_path)).count() > 0
