"""The register of queries, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL of the same rows if there is one."""

    def put(f: Query) -> Query:
        ALL[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.where(F.col("event_type").isin(*kinds)) if kinds else e


def rounded(*cols: str, n: int = 6) -> list[Column]:
    return [F.round(c, n).alias(c) for c in cols]
