"""Query registry: key -> (spark_fn(spark, sf_dir) -> DataFrame, DuckDB oracle SQL)."""

from __future__ import annotations

import functools
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from textlab.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB oracle (omit when not SQL-expressible)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str, *args, **kw) -> DataFrame:
            ship_package(spark)  # Python workers must be able to import textlab
            return fn(spark, sf_dir, *args, **kw)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table pruned to the columns that a text query reads; its partitions are those of the scan
    (``spark.sql.files.maxPartitionBytes``)."""
    df = table(spark, sf_dir, name)
    return df.select(*columns) if columns else df
