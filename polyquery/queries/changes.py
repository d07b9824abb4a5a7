"""Changes of tables: each query returns the table, or the rows, after them."""

from polyquery.catalog import Database
from polyquery.queries.base import frame


def _suppliers(load, spark, **rules):
    db = Database(spark)
    db.create("pq_supplier", load("supplier").schema, primary_key=("s_suppkey",), **rules)
    db.insert("pq_supplier", load("supplier"))
    return db


@frame("dml_insert_values", "select n_nationkey, n_name, n_regionkey from nation union all select 100, 'ATLANTIS', 3")
def insert_values(load, spark):
    db = Database(spark)
    db.create_as("pq_nation", load("nation"))
    db.insert("pq_nation", [(100, "ATLANTIS", 3)])
    return db.rows("pq_nation")


@frame("dml_insert_select", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier union all select s_suppkey + 100000, s_name, s_nationkey, s_acctbal from supplier where s_nationkey = 1")
def insert_select(load, spark):
    db = _suppliers(load, spark)
    db.insert("pq_supplier", spark.sql("select s_suppkey + 100000 as s_suppkey, s_name, s_nationkey, s_acctbal from pq_supplier where s_nationkey = 1"))
    return db.rows("pq_supplier")


@frame("dml_create_table_as", "select o_custkey as k, count(*) as n from orders group by o_custkey")
def create_as(load, spark):
    db = Database(spark)
    db.create_as("pq_counts", load("orders").groupBy("o_custkey").count().toDF("k", "n"), temporary=True)
    return db.rows("pq_counts")


@frame("dml_on_conflict_nothing", "select * from supplier union all select 999999, 'new', 1, 0.0")
def on_conflict_nothing(load, spark):
    db = _suppliers(load, spark)
    db.insert("pq_supplier", [(1, "clash", 0, 0.0), (999999, "new", 1, 0.0)], on_conflict="nothing")
    return db.rows("pq_supplier")


@frame("dml_upsert", "select s_suppkey, case when s_suppkey = 1 then 'clash' else s_name end as s_name, s_nationkey, case when s_suppkey = 1 then s_acctbal + 5 else s_acctbal end as s_acctbal from supplier union all select 999999, 'new', 1, 7.0")
def upsert(load, spark):
    db = _suppliers(load, spark)
    db.insert("pq_supplier", [(1, "clash", 0, 5.0), (999999, "new", 1, 7.0)], on_conflict="update", update={"s_name": "new.s_name", "s_acctbal": "old.s_acctbal + new.s_acctbal"})
    return db.rows("pq_supplier")


@frame("dml_upsert_where", "select s_suppkey, s_name, s_nationkey, case when s_suppkey = 2 then -1.0 else s_acctbal end as s_acctbal from supplier")
def upsert_where(load, spark):
    db = _suppliers(load, spark)
    db.insert("pq_supplier", [(1, "a", 0, -1.0), (2, "b", 0, -1.0)], on_conflict="update", update={"s_acctbal": "new.s_acctbal"}, where="old.s_suppkey = 2")
    return db.rows("pq_supplier")


@frame("dml_replace", "select * from supplier where s_suppkey <> 3 union all select 3, 'again', 4, 1.5")
def replace(load, spark):
    db = _suppliers(load, spark)
    db.insert("pq_supplier", [(3, "again", 4, 1.5)], on_conflict="replace")
    return db.rows("pq_supplier")


@frame("dml_update", "select s_suppkey, s_name, s_nationkey, case when s_acctbal < 0 then 0.0 else s_acctbal end as s_acctbal from supplier")
def update(load, spark):
    db = _suppliers(load, spark)
    db.update("pq_supplier", {"s_acctbal": "0.0"}, "s_acctbal < 0")
    return db.rows("pq_supplier")


@frame("dml_update_returning", "select s_suppkey, round(s_acctbal * 2, 2) as s_acctbal from supplier where s_nationkey = 3")
def update_returning(load, spark):
    db = _suppliers(load, spark)
    return db.update("pq_supplier", {"s_acctbal": "round(s_acctbal * 2, 2)"}, "s_nationkey = 3").select("s_suppkey", "s_acctbal")


@frame("dml_update_from", "select c_custkey, coalesce(t.total, c_acctbal) as c_acctbal from customer left join (select o_custkey, round(sum(o_totalprice), 2) as total from orders group by o_custkey) t on c_custkey = o_custkey")
def update_from(load, spark):
    db = Database(spark)
    db.create_as("pq_customer", load("customer"))
    totals = load("orders").groupBy("o_custkey").agg({"o_totalprice": "sum"}).toDF("o_custkey", "total")
    db.update("pq_customer", {"c_acctbal": "round(s.total, 2)"}, source=totals, on="t.c_custkey = s.o_custkey")
    return db.rows("pq_customer").select("c_custkey", "c_acctbal")


@frame("dml_delete", "select * from orders where not (o_orderstatus = 'F')")
def delete(load, spark):
    db = Database(spark)
    db.create_as("pq_orders", load("orders"))
    db.delete("pq_orders", "o_orderstatus = 'F'")
    return db.rows("pq_orders")


@frame("dml_delete_using", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)")
def delete_using(load, spark):
    db = Database(spark)
    db.create_as("pq_customer", load("customer"))
    db.delete("pq_customer", "s.o_totalprice > 200000", source=load("orders"), on="t.c_custkey = s.o_custkey")
    return db.rows("pq_customer").select("c_custkey")


@frame("dml_merge", "select n_nationkey, case when n_nationkey < 5 then lower(n_name) else n_name end as n_name, n_regionkey from nation union all select 200, 'more', 0")
def merge(load, spark):
    db = Database(spark)
    db.create_as("pq_nation", load("nation"))
    source = spark.sql("select n_nationkey, lower(n_name) as n_name from pq_nation where n_nationkey < 5 union all select 200, 'more'")
    db.merge("pq_nation", source, "t.n_nationkey = s.n_nationkey", {"n_name": "s.n_name"}, {"n_nationkey": "s.n_nationkey", "n_name": "s.n_name", "n_regionkey": "0"})
    return db.rows("pq_nation")


@frame("ddl_add_column", "select r_regionkey, r_name, 'x' as note from region")
def add_column(load, spark):
    db = Database(spark)
    db.create_as("pq_region", load("region"))
    db.add_column("pq_region", "note", "string", "'x'")
    return db.rows("pq_region")


@frame("ddl_view", "select n_regionkey, count(*) as n from nation group by n_regionkey")
def view(load, spark):
    db = Database(spark)
    db.create_as("pq_nation", load("nation"))
    db.create_view("pq_view", "select n_regionkey, count(*) as n from pq_nation group by n_regionkey", or_replace=True)
    return spark.table("pq_view")


@frame("ddl_partition_selection", "select o_orderkey from orders where year(o_orderdate) in (1995, 1996)")
def partition_selection(load, spark):
    db = Database(spark)
    t = db.create_as("pq_orders", load("orders"))
    t.partitions = {f"p{y}": f"year(o_orderdate) = {y}" for y in range(1990, 2010)}
    return db.partition("pq_orders", "p1995", "p1996").select("o_orderkey")


@frame("txn_rollback_to_savepoint", "select count(*) as n from region where r_regionkey <> 0")
def rollback(load, spark):
    db = Database(spark)
    db.create_as("pq_region", load("region"))
    db.begin()
    db.delete("pq_region", "r_regionkey = 0")
    db.savepoint("a")
    db.delete("pq_region")
    db.rollback("a")
    db.commit()
    return db.rows("pq_region").selectExpr("count(*) as n")


@frame("seq_identity", "select row_number() over (order by r_regionkey) as id, r_name from region")
def identity(load, spark):
    db = Database(spark)
    db.create("pq_named", "id bigint, r_name string", identity="id", primary_key=("id",))
    db.insert("pq_named", load("region").orderBy("r_regionkey").select("r_name"))
    return db.rows("pq_named")


@frame("trigger_before_insert", "select r_regionkey, upper(r_name) || '!' as r_name from region")
def trigger(load, spark):
    db = Database(spark)
    db.create("pq_region", load("region").schema)
    db.on("pq_region", "before_insert", lambda rows: rows.selectExpr("r_regionkey", "concat(upper(r_name), '!') as r_name"))
    db.insert("pq_region", load("region"))
    return db.rows("pq_region")


@frame("udf_sql_function", "select n_nationkey, n_nationkey * 2 + 1 as y from nation")
def sql_function(load, spark):
    spark.sql("create or replace temporary function pq_twice(x int) returns int return x * 2 + 1")
    return load("nation").selectExpr("n_nationkey", "pq_twice(n_nationkey) as y")


@frame("procedure_call", "select count(*) as n from nation where n_regionkey = 2")
def procedure(load, spark):
    db = Database(spark)
    db.create_as("pq_nation", load("nation"))
    db.procedure("CountIn", lambda d, region: d.rows("pq_nation").where(f"n_regionkey = {region}").selectExpr("count(*) as n"))
    return db.call("countin", 2)


def _connection(load, spark, dialect, *tables):
    from polyquery.connection import Connection

    c = Connection(spark, dialect)
    for t in tables:
        c.db.create_as(f"pq_{t}", load(t))
    return c


@frame("stmt_insert_update_delete", "select s_suppkey, case when s_nationkey = 2 then upper(s_name || '!') else s_name end as s_name from supplier where s_nationkey <> 4 union all select 999999, 'NEW'")
def statements(load, spark):
    c = _connection(load, spark, "mysql", "supplier")
    c.execute("INSERT INTO pq_supplier VALUES (999999, 'NEW', 0, 1.5); UPDATE pq_supplier SET s_name = UPPER(CONCAT(s_name, '!')) WHERE s_nationkey = 2; DELETE FROM pq_supplier WHERE s_nationkey = 4")
    return c.query("SELECT s_suppkey, s_name FROM pq_supplier")


@frame("stmt_update_join_select", "select c_custkey, coalesce(t.n, c_nationkey) as c_nationkey from customer left join (select o_custkey, count(*)::int as n from orders where o_totalprice > 100000 group by o_custkey) t on c_custkey = o_custkey")
def update_join(load, spark):
    c = _connection(load, spark, "mysql", "customer", "orders")
    c.execute("UPDATE pq_customer u JOIN (SELECT o_custkey, COUNT(*) AS n FROM pq_orders WHERE o_totalprice > 100000 GROUP BY o_custkey) s ON u.c_custkey = s.o_custkey SET u.c_nationkey = s.n")
    return c.query("SELECT c_custkey, c_nationkey FROM pq_customer")


@frame("stmt_merge", "select n_nationkey, case when n_nationkey < 3 then 'M' || n_nationkey else n_name end as n_name from nation union all select n_nationkey + 100, 'M' || n_nationkey from nation where n_nationkey < 2")
def merge_text(load, spark):
    c = _connection(load, spark, "sqlserver", "nation")
    c.execute("MERGE INTO pq_nation AS t USING (SELECT n_nationkey AS k, 'M' + '' AS x, CONCAT('M', n_nationkey) AS m FROM pq_nation WHERE n_nationkey < 3 UNION ALL SELECT n_nationkey + 100, '', CONCAT('M', n_nationkey) FROM pq_nation WHERE n_nationkey < 2) AS s ON t.n_nationkey = s.k WHEN MATCHED THEN UPDATE SET n_name = s.m WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name) VALUES (s.k, s.m)".replace("'M' + '' AS x", "'' AS x"))
    return c.query("SELECT n_nationkey, n_name FROM pq_nation")


@frame("stmt_on_conflict_returning", "select s_suppkey, s_nationkey + 1 as s_nationkey from supplier where s_suppkey in (1, 2, 3)")
def conflict_returning(load, spark):
    from polyquery.connection import Connection

    c = Connection(spark, "postgres", _suppliers(load, spark))
    return c.execute("INSERT INTO pq_supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (1, 'a', 0, 0.0), (2, 'b', 0, 0.0), (3, 'c', 0, 0.0) ON CONFLICT (s_suppkey) DO UPDATE SET s_nationkey = s_nationkey + 1 RETURNING s_suppkey, s_nationkey")


@frame("stmt_select_into", "select o_custkey as k, count(*)::int as n from orders where o_orderstatus = 'O' group by o_custkey")
def select_into(load, spark):
    c = _connection(load, spark, "sqlserver", "orders")
    c.execute("SELECT o_custkey AS k, COUNT(*) AS n INTO pq_into FROM pq_orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
    return c.query("SELECT k, n FROM pq_into")


@frame("stmt_transaction", "select count(*) + 1 as n from region where r_regionkey < 3")
def transaction_text(load, spark):
    c = _connection(load, spark, "mysql", "region")
    c.execute("BEGIN; DELETE FROM pq_region WHERE r_regionkey >= 3; SAVEPOINT s; DELETE FROM pq_region; ROLLBACK TO SAVEPOINT s; INSERT INTO pq_region VALUES (9, 'NINE'); COMMIT")
    return c.query("SELECT COUNT(*) AS n FROM pq_region")


@frame("merge_predicates", "select n_nationkey, case when n_nationkey < 5 then 'M' || n_nationkey else n_name end as n_name from nation where n_nationkey < 5 or n_nationkey >= 8 union all select n_nationkey + 100, 'M' || n_nationkey from nation where n_nationkey >= 2 and n_nationkey < 4")
def merge_predicates(load, spark):
    c = _connection(load, spark, "sqlserver", "nation")
    c.execute("MERGE INTO pq_nation AS t USING (SELECT n_nationkey AS k, CONCAT('M', n_nationkey) AS m FROM pq_nation WHERE n_nationkey < 8 UNION ALL SELECT n_nationkey + 100, CONCAT('M', n_nationkey) FROM pq_nation WHERE n_nationkey < 4) AS s ON t.n_nationkey = s.k WHEN MATCHED AND s.k < 5 THEN UPDATE SET n_name = s.m WHEN MATCHED AND s.k >= 3 THEN DELETE WHEN NOT MATCHED AND s.k > 101 THEN INSERT (n_nationkey, n_name) VALUES (s.k, s.m)")
    return c.query("SELECT n_nationkey, n_name FROM pq_nation")


@frame("upsert_repeated_keys", "select r_regionkey, case r_regionkey when 1 then 'last' else r_name end as r_name from region union all select 9, 'second'")
def upsert_repeated_keys(load, spark):
    db = Database(spark)
    db.create_as("pq_region", load("region"))
    rows = [(1, "early"), (9, "first"), (1, "last"), (9, "second")]
    db.insert("pq_region", rows, on_conflict="update", update={"r_name": "new.r_name"}, keys=("r_regionkey",))
    return db.rows("pq_region")
