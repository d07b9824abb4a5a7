"""Statements as text."""

import pytest

from polyquery.catalog import ConstraintError
from polyquery.connection import Connection
from polyquery.functions.registry import Unsupported


def got(c, sql):
    return sorted((tuple(r) for r in c.query(sql).collect()), key=str)


@pytest.fixture
def c(spark):
    c = Connection(spark, "mysql")
    c.execute("""
      CREATE TEMPORARY TABLE users (id INT PRIMARY KEY, name VARCHAR(100) NOT NULL, tenant INT DEFAULT 7, total DECIMAL(10,2) NULL, CHECK (total IS NULL OR total >= 0));
      INSERT INTO users (id, name, tenant) VALUES (1, 'A', 10), (2, 'B', 20), (3, 'C', 10);
      CREATE TABLE orders (id INT PRIMARY KEY, user_id INT REFERENCES users (id), amount INT);
      INSERT INTO orders VALUES (10, 1, 50), (11, 1, 60), (12, 3, 10)
    """)
    return c


def test_insert_forms(c):
    assert c.execute("INSERT INTO users (id, name) VALUES (4, 'D')") == 1
    assert c.execute("INSERT IGNORE INTO users (id, name) VALUES (4, 'X'), (5, 'E')") == 1
    assert c.execute("INSERT INTO users (id, name, tenant) SELECT id + 10, CONCAT(name, '!'), tenant FROM users WHERE id = 1") == 1
    assert got(c, "SELECT id, name, tenant FROM users WHERE id > 3") == [(11, "A!", 10), (4, "D", 7), (5, "E", 7)]
    with pytest.raises(ConstraintError):
        c.execute("INSERT INTO users (id, name) VALUES (1, 'again')")


def test_upserts(c, spark):
    assert c.execute("INSERT INTO users (id, name, tenant) VALUES (1, 'AA', 5), (9, 'I', 1) ON DUPLICATE KEY UPDATE name = VALUES(name), tenant = tenant + VALUES(tenant)") == 3
    assert got(c, "SELECT id, name, tenant FROM users WHERE id IN (1, 9)") == [(1, "AA", 15), (9, "I", 1)]
    p = Connection(spark, "postgres", c.db)
    p.execute("INSERT INTO users (id, name, tenant) VALUES (2, 'BB', 0) ON CONFLICT (id) DO NOTHING")
    rows = p.execute("INSERT INTO users (id, name, tenant) VALUES (2, 'BB', 1), (3, 'CC', 1) ON CONFLICT (id) DO UPDATE SET name = excluded.name WHERE users.tenant = 10 RETURNING id, name")
    assert [tuple(r) for r in rows.collect()] == [(3, "CC")]
    c.execute("REPLACE INTO users (id, name) VALUES (2, 'new')")
    assert got(c, "SELECT id, name, tenant FROM users WHERE id = 2") == [(2, "new", 7)]


def test_update_and_delete_from_select(c, spark):
    assert c.execute("UPDATE users u JOIN (SELECT user_id, SUM(amount) AS total FROM orders GROUP BY user_id) s ON u.id = s.user_id SET u.total = s.total WHERE u.tenant = 10") == 2
    assert [(i, float(t) if t is not None else None) for i, t in got(c, "SELECT id, total FROM users")] == [(1, 110.0), (2, None), (3, 10.0)]
    p = Connection(spark, "postgres", c.db)
    p.execute("UPDATE users SET tenant = s.n FROM (SELECT user_id, COUNT(*) AS n FROM orders GROUP BY user_id) s WHERE users.id = s.user_id")
    assert got(c, "SELECT id, tenant FROM users") == [(1, 2), (2, 20), (3, 1)]
    assert p.execute("DELETE FROM orders USING (SELECT id FROM users WHERE tenant = 1) s WHERE orders.user_id = s.id") == 1
    assert c.execute("DELETE o FROM orders o JOIN (SELECT id FROM users WHERE name = 'A') s ON o.user_id = s.id WHERE o.amount > 55") == 1
    assert got(c, "SELECT id FROM orders") == [(10,)]
    assert c.execute("UPDATE users SET name = UPPER(CONCAT(name, 'x')) WHERE id = 2") == 1
    rows = p.execute("DELETE FROM users WHERE id = 2 RETURNING name")
    assert [r.name for r in rows.collect()] == ["BX"]


def test_merge(c, spark):
    s = Connection(spark, "sqlserver", c.db)
    s.execute("MERGE INTO users AS t USING (SELECT 1 AS id, 'M' AS name UNION ALL SELECT 8, 'N') AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET t.name = s.name WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.id, s.name);")
    assert got(c, "SELECT id, name FROM users") == [(1, "M"), (2, "B"), (3, "C"), (8, "N")]


def test_transactions_and_views(c):
    c.execute("BEGIN; DELETE FROM orders; SAVEPOINT a; INSERT INTO orders VALUES (1, 1, 1); ROLLBACK TO SAVEPOINT a")
    assert got(c, "SELECT COUNT(*) FROM orders") == [(0,)]
    c.execute("ROLLBACK; CREATE OR REPLACE VIEW big AS SELECT id FROM orders WHERE amount > 20")
    assert got(c, "SELECT * FROM big") == [(10,), (11,)]
    c.execute("DROP VIEW big; ALTER TABLE orders ADD COLUMN note VARCHAR(10) DEFAULT 'n'")
    assert got(c, "SELECT note FROM orders WHERE id = 10") == [("n",)]


def test_sequences_and_session_values(c, spark):
    d = Connection(spark, "db2", c.db)
    d.execute("CREATE SEQUENCE s START WITH 5 INCREMENT BY 2 MAXVALUE 9 CYCLE")
    assert got(d, "SELECT NEXT VALUE FOR s AS a") == [(5,)]
    assert got(d, "SELECT NEXT VALUE FOR s AS a, PREVIOUS VALUE FOR s AS b") == [(7, 7)]
    c.execute("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, v INT); INSERT INTO t (v) VALUES (1), (2)")
    assert got(c, "SELECT LAST_INSERT_ID() AS i, ROW_COUNT() AS n") == [(2, 2)]


def test_tables_from_queries(c, spark):
    c.execute("CREATE TABLE copy AS SELECT id, name FROM users WHERE tenant = 10")
    s = Connection(spark, "sqlserver", c.db)
    s.execute("SELECT id INTO ids FROM users WHERE id < 3; CREATE UNIQUE INDEX u ON ids (id)")
    assert got(c, "SELECT COUNT(*) FROM copy") == [(2,)] and got(c, "SELECT id FROM ids") == [(1,), (2,)]
    with pytest.raises(ConstraintError):
        c.execute("INSERT INTO ids VALUES (1)")
    c.execute("DROP TABLE copy; DROP TABLE IF EXISTS nothing")


def test_functions_and_procedures(c):
    c.execute("CREATE FUNCTION twice(x INT) RETURNS INT RETURN x * 2")
    assert got(c, "SELECT twice(id) AS t FROM users WHERE id = 3") == [(6,)]
    c.db.procedure("add_user", lambda db, i, n: db.insert("users", [(i, n, 1, None)]) and db.row_count)
    c.execute("CALL add_user(30, 'P')")
    assert got(c, "SELECT name FROM users WHERE id = 30") == [("P",)]
    with pytest.raises(Unsupported):
        c.execute("GRANT ALL")
    assert "Plan" in c.execute("EXPLAIN SELECT id FROM users")


def test_partition_selection(c):
    c.db.tables["orders"].partitions = {"small": "amount < 20", "big": "amount >= 20"}
    assert got(c, "SELECT id FROM orders PARTITION (small)") == [(12,)]
    assert got(c, "SELECT o.id FROM orders PARTITION (small, big) o WHERE o.amount > 55") == [(11,)]
    with pytest.raises(Unsupported):
        c.execute("SELECT id FROM users PARTITION (p0)")
