"""Sinks: files, named tables, facts, metadata and samples."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdata.session import shared_folder


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for intermediate files below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, *, compress: bool = False, encoding: str = "UTF-8") -> None:
    """CSV with header, gzip if ``compress``; one file per task."""
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("encoding", encoding).option("compression", "gzip" if compress else "none").csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def assemble(spark: SparkSession, tables: dict[str, DataFrame], database: str | None = None, mode: str = "overwrite") -> None:
    """Write every named table to the catalog; each is its own distributed job."""
    if database:
        spark.sql(f"create database if not exists {database}")
    for name, df in tables.items():
        df.write.mode(mode).format("parquet").saveAsTable(f"{database}.{name}" if database else name)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write a set of tables so that readers see all of it or none; returns the id of the run.

    Tables go to a folder of the run, which nobody reads yet. The last step adds one row to the manifest, one
    file that Spark's commit puts in place at once: before it :func:`published` resolves to the
    set before, from it on to the new one. A run that fails leaves that folder behind and nothing else.
    """
    number = (_manifest(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    run = f"{number:08d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/runs/{run}/{name}")
    row = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(run).alias("run"), F.array(*map(F.lit, sorted(tables))).alias("tables"))
    row.withColumn("published", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return run


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    schema = "number long, run string, tables array<string>, published timestamp"
    try:
        return spark.read.schema(schema).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def published(spark: SparkSession, root: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest published run, or of a named one; empty before the first."""
    rows = _manifest(spark, root)
    row = (rows.where(F.col("run") == run) if run else rows).orderBy(F.desc("number"), F.desc("run")).first()
    return {name: spark.read.parquet(f"{root}/runs/{row.run}/{name}") for name in row.tables} if row else {}


def metadata(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    """Key/value table with the time it was generated."""
    rows = spark.createDataFrame(list(entries.items()), "key string, value string")
    stamp = spark.range(1).select(
        F.lit("db_generated").alias("key"), F.current_timestamp().cast("string").alias("value")
    )
    return rows.unionByName(stamp)


def last_updated(spark: SparkSession, datasets: list[str]) -> DataFrame:
    """One stamp per dataset refreshed in this run."""
    return spark.createDataFrame([(d,) for d in datasets], "dataset string").withColumn(
        "updated", F.date_trunc("second", F.current_timestamp())
    )


def facts(*named: tuple[str, DataFrame]) -> DataFrame:
    """One table (name, value) out of one-row, one-column aggregates."""
    out = None
    for name, df in named:
        row = df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``n`` rows, the same on every run: smallest seeded digests of the key.

    Spark keeps ``n`` rows per task and merges these; nothing is sorted as a whole.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(digest, key).limit(n)
