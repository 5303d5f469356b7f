"""Queries by name, and for each that SQL can express the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, spark_sql: str, oracle: str | None = None, *tables: str) -> None:
    """Registers a query in SQL over the named tables; the oracle defaults to the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Names in braces are frames of this query alone.
        return spark.sql(spark_sql, **{t: read(spark, sf_dir, t) for t in tables})

    QUERIES[name] = run
    plain = oracle if oracle is not None else spark_sql
    for t in TABLES:
        plain = plain.replace("{" + t + "}", t)
    ORACLES[name] = plain
