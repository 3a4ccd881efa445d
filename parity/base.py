"""Registration of a query together with its SQL, and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    """Decorator: register the function as a query, with its SQL when it has one."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str, spread: bool = False) -> DataFrame:
    """A given table. `spread` deals the rows of a single small file out to all cores; tables of
    several files are split by the scan itself."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if spread and len(df.inputFiles()) == 1:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
