"""The engine: named tables, and queries of any dialect over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyquery.functions import udfs
from polyquery.plans.translate import Translated, translate
from polyquery.profiles import profile


class Engine:
    """Tables and queries of one dialect on a Spark session.

    ``sql`` translates and returns a lazy DataFrame; Catalyst plans the whole.
    """

    def __init__(self, spark: SparkSession, dialect: str = "standard"):
        self.spark, self.rules = spark, profile(dialect)
        self.last: Translated | None = None

    def register(self) -> None:
        """The functions that Spark lacks; only queries that call one need them."""
        from polyquery.operators.json_table import register

        udfs.register(self.spark)
        register(self.spark)

    def table(self, name: str, df: DataFrame) -> Engine:
        """Make ``df`` known as ``name``."""
        df.createOrReplaceTempView(name)
        return self

    def load(self, sf_dir: str, *names: str) -> Engine:
        """Parquet tables below a folder under their names."""
        for name in names:
            self.table(name, self.spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return self

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        self.last = translate(text, self.rules)
        if "pq_" in self.last.sql:
            self.register()
        return self.spark.sql(self.last.sql, args=args) if args else self.spark.sql(self.last.sql)

    def found_rows(self) -> int:
        """Rows of the last query without its limit, if it had SQL_CALC_FOUND_ROWS."""
        if self.last is None or not self.last.found_rows:
            raise ValueError("the last query had no SQL_CALC_FOUND_ROWS")
        return self.spark.sql(self.last.found_rows).count()
