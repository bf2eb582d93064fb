"""Named tables and user SQL over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables available to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table(spark: SparkSession, name: str) -> DataFrame:
    """A named table; columns that are not used later are never read."""
    return spark.table(name)


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("show tables").select("tableName").withColumnRenamed("tableName", "name")


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)
