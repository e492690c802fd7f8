"""Registration of queries with their SQL twin, and access to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def registrar(registry: dict):
    """Decorator factory: ``@query("name", sql)`` over ``fn(tables) -> DataFrame``."""

    def query(name: str, sql: str | None = None):
        def add(fn):
            registry[name] = (lambda spark, folder: fn(Tables(spark, folder)), sql)
            return fn

        return add

    return query


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for comparison: sums of doubles depend on the order of addition."""
    for c in columns:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))
    return df
