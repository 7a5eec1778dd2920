"""How queries are registered: a function of (spark, sf_dir) and its SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict, object]:
    found: dict = {}

    def query(sql: str | None = None):
        def add(function):
            found[function.__name__] = (function, sql)
            return function

        return add

    return found, query
