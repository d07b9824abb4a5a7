"""Window frames that Spark SQL lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[Column | str], start: int | None, end: int | None, **columns: Column) -> DataFrame:
    """Aggregates over a GROUPS frame: ``start`` and ``end`` count peer groups from the row's own; None is unbounded.

    Peers share a dense rank, so the frame is a RANGE over it: one more window of the same sort.
    """
    ranked = df.withColumn("pq_peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("pq_peer").rangeBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)
    return ranked.select(*df.columns, *(c.over(frame).alias(n) for n, c in columns.items()))


def ntile_by_share(n: int, partition: list[str], order: list[Column | str]) -> Column:
    """The bucket floor(i * n / count) + 1 of the compat mode, i counting from 0."""
    w = Window.partitionBy(*partition)
    return F.floor((F.row_number().over(w.orderBy(*order)) - 1) * n / F.count(F.lit(1)).over(w)) + 1


def count_distinct_over(column: Column | str, window) -> Column:
    return F.size(F.collect_set(column).over(window))
