"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """CSV with a header, commas and a declared schema: the file is read once, not to guess types."""
    return spark.read.csv(path, schema=schema, header=header, enforceSchema=False, mode="FAILFAST")


def append_csv(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """A table with a CSV's rows behind it, columns matched by the header."""
    return table.unionByName(read_csv(spark, path, table.schema))


def seed(spark: SparkSession, rows: Iterable, schema: str | T.StructType) -> DataFrame:
    """Objects or tuples as a table."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([tuple(getattr(r, n) for n in kind.names) if not isinstance(r, tuple | list | dict) else r for r in rows], kind)


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Parquet, ORC, JSON, text, JDBC: whatever Spark reads."""
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    out = df.write.format(kind).mode(mode)
    (out.partitionBy(*by) if by else out).save(path)


def partition_by_year(df: DataFrame, column: str, path: str) -> None:
    """A table laid out by the year of a column, for pruning by directory."""
    from pyspark.sql import functions as F

    df.withColumn("year", F.year(column)).write.partitionBy("year").parquet(path)
