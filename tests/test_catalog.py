"""Changes, constraints, transactions, sequences."""

import pytest

from polyquery.catalog import ConstraintError, Database, Foreign, Sequence


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.create("users", "id bigint not null, name string, tenant int, total decimal(10,2)", primary_key=("id",), defaults={"tenant": "7"}, checks={"positive": "total is null or total >= 0"})
    d.insert("users", [(1, "Ana", 10, None), (2, "Bob", 20, None)])
    return d


def names(d, table="users"):
    return sorted(r.name for r in d.rows(table).collect())


def test_defaults_and_counts(db):
    db.insert("users", [(3, "Cid")], columns=["id", "name"])
    assert db.row_count == 1
    assert db.rows("users").where("id = 3").first()["tenant"] == 7


@pytest.mark.parametrize("row", [(1, "again", 1, None), (None, "x", 1, None), (9, "x", 1, -1)])
def test_constraints(db, row):
    from decimal import Decimal

    row = tuple(Decimal(x) if i == 3 and x is not None else x for i, x in enumerate(row))
    with pytest.raises((ConstraintError, Exception)):
        db.insert("users", [row])
    assert names(db) == ["Ana", "Bob"]


def test_foreign_keys(db):
    db.create("orders", "id bigint, user_id bigint", foreign=(Foreign(("user_id",), "users", ("id",)),))
    db.insert("orders", [(1, 1)])
    with pytest.raises(ConstraintError):
        db.insert("orders", [(2, 99)])
    with pytest.raises(ConstraintError):
        db.delete("users", "id = 1")
    with pytest.raises(ConstraintError):
        db.drop("users")
    db.delete("users", "id = 2")
    assert names(db) == ["Ana"]


def test_unique_index(db):
    db.create_index("users", "u", "name", unique=True)
    with pytest.raises(ConstraintError):
        db.insert("users", [(5, "Ana", 1, None)])


def test_upsert_counts(db):
    db.insert("users", [(1, "Ann", 1, None), (4, "Dan", 1, None)], on_conflict="update", update={"name": "new.name"}, count_updates_double=True)
    assert db.row_count == 3
    assert names(db) == ["Ann", "Bob", "Dan"]


def test_savepoints(db):
    db.begin()
    db.insert("users", [(3, "Cid", 1, None)])
    db.savepoint("a")
    db.delete("users")
    db.create("extra", "x int")
    db.rollback("a")
    assert names(db) == ["Ana", "Bob", "Cid"] and "extra" not in db.tables
    db.rollback()
    assert names(db) == ["Ana", "Bob"]
    with pytest.raises(ValueError):
        db.rollback("gone")


def test_update_from_takes_a_row_once(db, spark):
    source = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "user_id long, amount int")
    db.update("users", {"tenant": "s.amount"}, source=source, on="t.id = s.user_id")
    assert sorted((r.id, r.tenant) for r in db.rows("users").collect()) == [(1, 5), (2, 6)]


def test_merge_with_delete(db, spark):
    source = spark.createDataFrame([(1, "drop"), (3, "Cid")], "id long, name string")
    db.merge("users", source, "t.id = s.id", {"name": "s.name"}, {"id": "s.id", "name": "s.name"}, delete_when="s.name = 'drop'")
    assert names(db) == ["Bob", "Cid"]


def test_computed_identity_and_triggers(spark):
    d = Database(spark)
    d.create("t", "id bigint, a int, twice int", identity="id", computed={"twice": "a * 2"})
    seen = []
    d.on("t", "after_insert", lambda rows: seen.append(rows.count()))
    d.insert("t", [(5,), (6,)], columns=["a"])
    d.insert("t", [(7,)], columns=["a"])
    assert sorted(tuple(r) for r in d.rows("t").collect()) == [(1, 5, 10), (2, 6, 12), (3, 7, 14)]
    assert seen == [2, 1] and d.last_identity == 3


def test_partitions(spark):
    d = Database(spark)
    d.create("p", "y int", partitions={"p0": "y < 2000", "p1": "y between 2000 and 2009"})
    d.insert("p", [(1999,), (2005,)])
    with pytest.raises(ConstraintError):
        d.insert("p", [(2020,)])
    assert [r.y for r in d.partition("p", "p1").collect()] == [2005]


def test_sequences():
    s = Sequence(start=1, increment=2, most=5, cycle=True, least=1)
    assert [s.next() for _ in range(4)] == [1, 3, 5, 1]
    with pytest.raises(ConstraintError):
        Sequence().previous()
    with pytest.raises(ConstraintError):
        short = Sequence(most=2)
        for _ in range(3):
            short.next()


def test_snapshot_round_trip(db, spark):
    db.sequence("s", start=5)
    text = db.snapshot()
    other = Database(spark)
    other.restore(text)
    assert other.differences(text) == []
    other.drop("users")
    assert other.differences(text) == ["tables users: only there"]
