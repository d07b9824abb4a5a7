"""How a query is registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyquery.plans.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def sql(name: str, text: str, oracle: str | None = None, dialect: str = "standard") -> None:
    """A query in a dialect; ``oracle`` if the other engine writes it differently."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, dialect).load(sf_dir, *tables_of(text)).sql(text)

    run.__name__ = name
    CASES[name] = run
    ORACLES[name] = oracle or text


def frame(name: str, oracle: str | None = None):
    """A query as a function of (load, spark), where load(table) gives a DataFrame."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)

        run.__name__ = name
        CASES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep
