"""Tables that change: versions, constraints, transactions, sequences, triggers.

A table's name stands for an immutable DataFrame; a change computes the next
version and moves the name. Savepoints are saved references, so rolling back is
free. Checks run as aggregations before a version is taken. The state is the
driver's: one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(ValueError):
    """A change that a constraint forbids."""


@dataclass(frozen=True)
class Foreign:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]


@dataclass
class Table:
    """Schema and rules of a table, and its current version."""

    schema: T.StructType
    rows: DataFrame
    primary_key: tuple[str, ...] = ()
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: tuple[Foreign, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    identity: str | None = None
    next_identity: int = 1
    partition: str | None = None
    partitions: dict[str, str] = field(default_factory=dict)
    triggers: dict[str, list[Callable[[DataFrame], DataFrame | None]]] = field(default_factory=dict)


@dataclass
class Sequence:
    """start, increment, bounds and whether it begins again."""

    start: int = 1
    increment: int = 1
    least: int | None = None
    most: int | None = None
    cycle: bool = False
    current: int | None = None

    def next(self) -> int:
        value = self.start if self.current is None else self.current + self.increment
        if self.most is not None and value > self.most or self.least is not None and value < self.least:
            if not self.cycle:
                raise ConstraintError("the sequence is used up")
            value = (self.least if self.least is not None else self.start) if self.increment > 0 else (self.most if self.most is not None else self.start)
        self.current = value
        return value

    def previous(self) -> int:
        if self.current is None:
            raise ConstraintError("the sequence has no value yet")
        return self.current

    def column(self, order: Column) -> Column:
        """A value for every row of a bounded change, in ``order``; advance() afterwards."""
        from pyspark.sql import Window

        first = self.start if self.current is None else self.current + self.increment
        return F.lit(first) + (F.row_number().over(Window.orderBy(order)) - 1) * self.increment

    def advance(self, n: int) -> None:
        if n:
            self.current = (self.start if self.current is None else self.current + self.increment) + (n - 1) * self.increment


class Database:
    """Named tables, views, sequences and procedures with transactions."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.sequences: dict[str, Sequence] = {}
        self.procedures: dict[str, Callable] = {}
        self.temporary: set[str] = set()
        self.saved: list[tuple[str, dict[str, Table], dict[str, Sequence]]] = []
        self.row_count = 0
        self.last_identity: int | None = None

    # definitions

    def create(self, name: str, schema: str | T.StructType, *, if_not_exists: bool = False, temporary: bool = False, **rules) -> Table:
        if name in self.tables:
            if if_not_exists:
                return self.tables[name]
            raise ValueError(f"{name} exists")
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.tables[name] = Table(kind, self.spark.createDataFrame([], kind), **rules)
        if temporary:
            self.temporary.add(name)
        self._publish(name)
        return self.tables[name]

    def create_as(self, name: str, df: DataFrame, temporary: bool = False) -> Table:
        """CREATE TABLE ... AS SELECT, SELECT INTO."""
        if name in self.tables:
            raise ValueError(f"{name} exists")
        self.tables[name] = Table(df.schema, df)
        if temporary:
            self.temporary.add(name)
        self._publish(name)
        return self.tables[name]

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables:
            if if_exists:
                return
            raise KeyError(name)
        for other, t in self.tables.items():
            if other != name and any(f.table == name for f in t.foreign):
                raise ConstraintError(f"{other} refers to {name}")
        del self.tables[name]
        self.temporary.discard(name)
        self.spark.catalog.dropTempView(name)

    def add_column(self, name: str, column: str, kind: str, default: str = "null") -> None:
        t = self.tables[name]
        rows = t.rows.withColumn(column, F.expr(f"cast({default} as {kind})"))
        self.tables[name] = replace(t, schema=rows.schema, rows=rows)
        self._publish(name)

    def create_view(self, name: str, query: str, or_replace: bool = False) -> None:
        if name in self.views and not or_replace:
            raise ValueError(f"{name} exists")
        self.views[name] = query
        self.spark.sql(query).createOrReplaceTempView(name)

    def drop_view(self, name: str) -> None:
        del self.views[name]
        self.spark.catalog.dropTempView(name)

    def create_index(self, table: str, name: str, *columns: str, unique: bool = False) -> None:
        """Only uniqueness has an effect: Spark finds rows by statistics and partitions."""
        if unique:
            t = self.tables[table]
            changed = replace(t, unique=t.unique | {name: columns})
            self._check(table, changed)
            self.tables[table] = changed

    def sequence(self, name: str, **options) -> Sequence:
        self.sequences[name] = Sequence(**options)
        return self.sequences[name]

    def on(self, table: str, event: str, call: Callable[[DataFrame], DataFrame | None]) -> None:
        """A trigger: before_insert, after_insert, before_update, after_update, before_delete, after_delete.

        It gets the changed rows; what a before_insert trigger returns is inserted instead.
        """
        self.tables[table].triggers.setdefault(event, []).append(call)

    def procedure(self, name: str, call: Callable) -> None:
        self.procedures[name.lower()] = call

    def call(self, name: str, *args, **named):
        """CALL/EXECUTE: out and return values are what the Python function returns."""
        return self.procedures[name.lower()](self, *args, **named)

    # transactions

    def begin(self) -> None:
        self.savepoint("")

    def savepoint(self, name: str) -> None:
        self.saved.append((name, dict(self.tables), {k: replace(s) for k, s in self.sequences.items()}))

    def rollback(self, to: str = "") -> None:
        """To a savepoint, which stays, or to the transaction's start."""
        at = max((i for i, (n, *_) in enumerate(self.saved) if n == to), default=None)
        if at is None:
            raise ValueError(f"no savepoint {to!r}")
        _, tables, sequences = self.saved[at]
        for name in set(self.tables) - set(tables):
            self.spark.catalog.dropTempView(name)
        self.tables, self.sequences = dict(tables), {k: replace(s) for k, s in sequences.items()}
        self.saved = self.saved[: at + bool(to)]
        for name in self.tables:
            self._publish(name)

    def release(self, name: str) -> None:
        self.saved = self.saved[: max(i for i, (n, *_) in enumerate(self.saved) if n == name)]

    def commit(self) -> None:
        self.saved.clear()

    # changes

    def rows(self, name: str) -> DataFrame:
        return self.tables[name].rows

    def insert(self, name: str, rows: DataFrame | list, columns: list[str] | None = None, *, on_conflict: str = "error", update: dict[str, str] | None = None, where: str | None = None, keys: tuple[str, ...] = (), count_updates_double: bool = False) -> DataFrame:
        """INSERT; the rows that were inserted or updated come back (RETURNING, OUTPUT).

        ``on_conflict``: error, nothing, update (with ``update``: column ->
        expression over ``old`` and ``new``, and ``where``) or replace.
        Missing columns take their default, the identity or NULL.
        """
        t = self.tables[name]
        if isinstance(rows, list):
            names = columns or [f.name for f in t.schema if f.name != t.identity and f.name not in t.computed]
            rows = self.spark.createDataFrame(rows, T.StructType([t.schema[n] for n in names]))
        new = self._complete(t, rows)
        for call in t.triggers.get("before_insert", []):
            new = call(new) or new
        keys = keys or t.primary_key or next(iter(t.unique.values()), ())
        self.row_count = 0
        if on_conflict == "error" or not keys:
            after, changed = t.rows.unionByName(new), new
            self.row_count = new.count()
        else:
            match = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
            new = self._one(new, keys, first=on_conflict == "nothing")
            fresh = new.alias("new").join(t.rows.select(*keys).alias("old"), match, "left_anti")
            if on_conflict == "nothing":
                after, changed = t.rows.unionByName(fresh), fresh
                self.row_count = fresh.count()
            elif on_conflict == "replace":
                after, changed = t.rows.alias("old").join(new.select(*keys).alias("new"), match, "left_anti").unionByName(new), new
                self.row_count = new.count()
            elif on_conflict == "update":
                both = t.rows.alias("old").join(new.alias("new"), match, "left")
                hit = F.col(f"new.{keys[0]}").isNotNull() & F.coalesce(F.expr(where or "true"), F.lit(False))
                cells = [F.when(hit, F.expr((update or {})[f.name])).otherwise(F.col(f"old.{f.name}")).cast(f.dataType).alias(f.name) if f.name in (update or {}) else F.col(f"old.{f.name}").alias(f.name) for f in t.schema]
                kept = both.select(*cells, hit.alias("pq_hit"))
                updated = kept.where("pq_hit").drop("pq_hit")
                after, changed = kept.drop("pq_hit").unionByName(fresh), updated.unionByName(fresh)
                self.row_count = fresh.count() + updated.count() * (2 if count_updates_double else 1)
            else:
                raise ValueError(on_conflict)
        self._take(name, after)
        for call in t.triggers.get("after_insert", []):
            call(changed)
        return changed

    @staticmethod
    def _one(new: DataFrame, keys: tuple[str, ...] | list[str], first: bool) -> DataFrame:
        """Of new rows with one key the first or the last; rows with a NULL in the key are all kept."""
        whole = F.lit(True)
        for k in keys:
            whole &= F.col(k).isNotNull()
        pick = F.min_by if first else F.max_by
        one = new.where(whole).withColumn("pq_at", F.monotonically_increasing_id()).groupBy(*keys).agg(pick(F.struct(*new.columns), "pq_at").alias("r")).select("r.*")
        return one.unionByName(new.where(~whole))

    def update(self, name: str, set_: dict[str, str], where: str = "true", source: DataFrame | None = None, on: str | None = None) -> DataFrame:
        """UPDATE ... SET ... [FROM source ON ...] WHERE; expressions see the table as ``t`` and the source as ``s``."""
        t = self.tables[name]
        rows = t.rows.alias("t")
        if source is not None:
            # a row that several source rows match is updated once
            numbered = t.rows.withColumn("pq_row", F.monotonically_increasing_id())
            rows = numbered.alias("t").join(source.withColumn("pq_match", F.lit(True)).alias("s"), F.expr(on), "left")
            hit = F.col("s.pq_match").isNotNull() & F.coalesce(F.expr(where), F.lit(False))
        else:
            hit = F.coalesce(F.expr(where), F.lit(False))
        cells = [F.when(hit, F.expr(set_[f.name])).otherwise(F.col(f"t.{f.name}")).cast(f.dataType).alias(f.name) if f.name in set_ else F.col(f"t.{f.name}").alias(f.name) for f in t.schema]
        after = rows.select(*cells, hit.alias("pq_hit"), *([F.col("t.pq_row").alias("pq_row")] if source is not None else []))
        if source is not None:
            after = after.groupBy("pq_row").agg(F.max_by(F.struct(*[f.name for f in t.schema]), "pq_hit").alias("r"), F.max("pq_hit").alias("pq_hit")).select("r.*", "pq_hit")
        for column, text in t.computed.items():
            after = after.withColumn(column, F.expr(text))
        changed = after.where("pq_hit").drop("pq_hit")
        self._fire(t, "before_update", changed)
        self.row_count = changed.count()
        self._take(name, after.drop("pq_hit"))
        self._fire(t, "after_update", changed)
        return changed

    def delete(self, name: str, where: str = "true", source: DataFrame | None = None, on: str | None = None) -> DataFrame:
        """DELETE [USING source ON ...] WHERE; the deleted rows come back."""
        t = self.tables[name]
        if source is not None:
            match = F.expr(f"({on}) and ({where})")
            gone = t.rows.alias("t").join(source.alias("s"), match, "left_semi")
            after = t.rows.alias("t").join(source.alias("s"), match, "left_anti")
        else:
            hit = F.coalesce(F.expr(where), F.lit(False))
            gone, after = t.rows.alias("t").where(hit), t.rows.alias("t").where(~hit)
        self._fire(t, "before_delete", gone)
        self.row_count = gone.count()
        for other, o in self.tables.items():
            for f in o.foreign:
                if f.table == name and not o.rows.alias("o").join(gone.alias("g"), [F.col(f"o.{a}") == F.col(f"g.{b}") for a, b in zip(f.columns, f.references)], "left_semi").isEmpty():
                    raise ConstraintError(f"{other} refers to deleted rows of {name}")
        self._take(name, after, check=False)
        self._fire(t, "after_delete", gone)
        return gone

    def merge(self, name: str, source: DataFrame, on: str, matched: dict[str, str] | None = None, not_matched: dict[str, str] | None = None, delete_when: str | None = None, matched_when: str | None = None, not_matched_when: str | None = None) -> None:
        """MERGE: update matched rows, delete those of ``delete_when``, insert others; the table is ``t``, the source ``s``.

        ``matched_when`` and ``not_matched_when`` are the branches' own conditions.
        Several source rows that would change one row are an error.
        """
        t = self.tables[name]
        old = t.rows.withColumn("pq_old", F.monotonically_increasing_id()).alias("t")
        new = source.withColumn("pq_new", F.lit(True)).alias("s")
        both = old.join(new, F.expr(on), "full_outer")
        is_old, is_new = F.col("t.pq_old").isNotNull(), F.col("s.pq_new").isNotNull()
        holds = lambda text: F.coalesce(F.expr(text), F.lit(False)) if text else F.lit(True)
        change = is_old & is_new & holds(matched_when) if matched else F.lit(False)
        gone = is_old & is_new & holds(delete_when) if delete_when else F.lit(False)
        made = ~is_old & is_new & holds(not_matched_when) if not_matched else F.lit(False)
        if (matched or delete_when) and not both.where(change | gone).groupBy("t.pq_old").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ConstraintError(f"several source rows change one row of {name}")
        cells = []
        for f in t.schema:
            cell = F.col(f"t.{f.name}")
            if matched and f.name in matched:
                cell = F.when(change, F.expr(matched[f.name])).otherwise(cell)
            if not_matched:
                cell = F.when(made, F.expr(not_matched.get(f.name, t.defaults.get(f.name, "null")))).otherwise(cell)
            cells.append(cell.cast(f.dataType).alias(f.name))
        # source rows that change nothing must not repeat the row that they match
        idle = is_old & is_new & ~change & ~gone
        kept = both.where((is_old & ~is_new & ~gone) | (change & ~gone) | made).select(*cells)
        if matched_when or not matched:
            touched = both.where(change | gone).select(F.col("t.pq_old").alias("pq_touched")).distinct()
            rows = both.where(idle).dropDuplicates(["pq_old"]).join(touched, F.col("t.pq_old") == F.col("pq_touched"), "left_anti")
            kept = kept.unionByName(rows.select(*[F.col(f"t.{f.name}").alias(f.name) for f in t.schema]))
        self.row_count = both.where(change | gone | made).count()
        self._take(name, kept)

    # rules

    def _complete(self, t: Table, rows: DataFrame) -> DataFrame:
        given = {c.lower(): c for c in rows.columns}
        cells = []
        identity = None
        for f in t.schema:
            if f.name.lower() in given and f.name not in t.computed:
                cells.append(F.col(given[f.name.lower()]).cast(f.dataType).alias(f.name))
            elif f.name == t.identity:
                identity = f
                cells.append(F.lit(None).cast(f.dataType).alias(f.name))
            else:
                cells.append(F.expr(t.defaults.get(f.name, "null")).cast(f.dataType).alias(f.name))
        out = rows.select(*cells)
        if identity is not None:
            n = out.count()
            # consecutive values by the rows' places, without gathering them in one task
            first = t.next_identity
            order = [f.name for f in t.schema if f.name != t.identity]
            numbered = out.drop(t.identity).rdd.zipWithIndex().map(lambda p: (*p[0], p[1] + first)) if n else None
            if numbered is not None:
                out = self.spark.createDataFrame(numbered, T.StructType([*(t.schema[c] for c in order), T.StructField(t.identity, T.LongType())])).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in t.schema])
                self.last_identity = first + n - 1
                t.next_identity = first + n
        for column, text in t.computed.items():
            out = out.withColumn(column, F.expr(text).cast(t.schema[column].dataType))
        return out

    def _fire(self, t: Table, event: str, rows: DataFrame) -> None:
        for call in t.triggers.get(event, []):
            call(rows)

    def _take(self, name: str, rows: DataFrame, check: bool = True) -> None:
        changed = replace(self.tables[name], rows=rows)
        if check:
            self._check(name, changed)
        self.tables[name] = changed
        self._publish(name)

    def _check(self, name: str, t: Table) -> None:
        """One aggregation for NOT NULL and CHECK, one for each key."""
        required = [f.name for f in t.schema if not f.nullable or f.name in t.primary_key]
        tests = {f"{c} is null": F.col(c).isNull() for c in required} | {f"check {k}": ~F.coalesce(F.expr(text), F.lit(True)) for k, text in t.checks.items()}
        if t.partitions:
            tests |= {"no partition": ~F.coalesce(F.expr(" or ".join(f"({p})" for p in t.partitions.values())), F.lit(False))}
        if tests:
            row = t.rows.agg(*(F.count_if(test).alias(str(i)) for i, test in enumerate(tests.values()))).first()
            for i, what in enumerate(tests):
                if row[str(i)]:
                    raise ConstraintError(f"{name}: {what} in {row[str(i)]} rows")
        for what, columns in (("primary key", t.primary_key), *t.unique.items()):
            if columns:
                full = t.rows.where(" and ".join(f"`{c}` is not null" for c in columns))
                if not full.groupBy(*columns).count().where("count > 1").isEmpty():
                    raise ConstraintError(f"{name}: {what} ({', '.join(columns)}) isn't unique")
        for f in t.foreign:
            full = t.rows.where(" and ".join(f"`{c}` is not null" for c in f.columns))
            other = (t.rows if f.table == name else self.tables[f.table].rows).alias("p")
            if not full.alias("c").join(other, [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(f.columns, f.references)], "left_anti").isEmpty():
                raise ConstraintError(f"{name}: {f.columns} not in {f.table}")

    def partition(self, name: str, *parts: str) -> DataFrame:
        """FROM t PARTITION (p0, p1)."""
        t = self.tables[name]
        return t.rows.where(" or ".join(f"({t.partitions[p]})" for p in parts))

    def _publish(self, name: str) -> None:
        self.tables[name].rows.createOrReplaceTempView(name)

    # snapshots

    def snapshot(self) -> str:
        """Schemas, rules, views and sequences as JSON."""
        out = {
            "tables": {n: {"schema": t.schema.jsonValue(), "primary_key": t.primary_key, "unique": t.unique, "foreign": [vars(f) for f in t.foreign], "checks": t.checks, "defaults": t.defaults, "computed": t.computed, "identity": t.identity, "partitions": t.partitions} for n, t in sorted(self.tables.items()) if n not in self.temporary},
            "views": dict(sorted(self.views.items())),
            "sequences": {n: vars(s) for n, s in sorted(self.sequences.items())},
        }
        return json.dumps(out, indent=1)

    def restore(self, text: str) -> None:
        """Make the tables, views and sequences of a snapshot."""
        saved = json.loads(text)
        for n, t in saved["tables"].items():
            self.create(n, T.StructType.fromJson(t["schema"]), primary_key=tuple(t["primary_key"]), unique={k: tuple(v) for k, v in t["unique"].items()}, foreign=tuple(Foreign(tuple(f["columns"]), f["table"], tuple(f["references"])) for f in t["foreign"]), checks=t["checks"], defaults=t["defaults"], computed=t["computed"], identity=t["identity"], partitions=t["partitions"])
        for n, q in saved["views"].items():
            self.create_view(n, q, or_replace=True)
        for n, s in saved["sequences"].items():
            self.sequences[n] = Sequence(**s)

    def differences(self, text: str) -> list[str]:
        """What differs from a snapshot."""
        a, b = json.loads(self.snapshot()), json.loads(text)
        return sorted(f"{kind} {n}: {'only here' if n not in b[kind] else 'only there' if n not in a[kind] else 'differs'}" for kind in a for n in {*a[kind], *b[kind]} if a[kind].get(n) != b[kind].get(n))
