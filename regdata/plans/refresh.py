"""Refresh: read landed files, check them, and write the tables if all checks pass."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdata.operators import quality, series
from regdata.schemas import FLOORS, REQUIRED, schema_of
from regdata.session import materialise
from regdata.sources import readers, sinks

COUNTS = "accepted_counts"  # the table of rows per dataset that the next run is held against


def landed(spark: SparkSession, paths: dict[str, str], fmt: str = "csv", multiline: bool = False) -> dict[str, DataFrame | None]:
    """Landed datasets under their schema, with the columns they really have; None where unreadable.

    ``multiline`` is for files whose cells hold line breaks; such a file is read by one task.
    """
    out: dict[str, DataFrame | None] = {}
    for name, path in paths.items():
        raw = quality.load_or_none(spark, path, fmt) if fmt != "csv" else _csv_or_none(spark, path)
        out[name] = None if raw is None else readers.read_table(spark, path, _present(name, raw.columns), fmt=fmt, multiline=multiline)
    return out


def _csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """Header of a CSV dataset as a table of text columns."""
    try:
        return spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() in quality.UNREADABLE:
            return None
        raise


def _present(name: str, columns: list[str]):
    """The dataset's schema in the order of the file, unknown columns as text."""
    from pyspark.sql.types import StringType, StructField, StructType

    known = {f.name.lower(): f for f in schema_of(name)}
    return StructType([known.get(c.lower(), StructField(c, StringType())) for c in columns])


def extended_wages(wages: DataFrame, payroll: DataFrame) -> DataFrame:
    """Wage index carried forward to the last payroll year; growth columns are 0 there."""
    zero = [c for c in wages.columns if c not in ("Year", "AWI")]
    return series.extend_yearly(wages, "Year", payroll.agg(F.max("year")).scalar(), ["AWI"], zero)


def refresh(
    spark: SparkSession, paths: dict[str, str], root: str, database: str | None = None, fmt: str = "csv",
) -> DataFrame:
    """Check all landed datasets; if every check passes, publish tables, metadata and the new counts below ``root``.

    Returns the checks, one row per dataset, against the counts of the last published run. All tables and the
    counts become visible by one write (see :func:`regdata.sources.sinks.publish`): a failed check, and
    a failure between two tables, leave the last good set as it is. With ``database`` the published tables get
    views of that catalog.
    """
    tables = landed(spark, paths, fmt)
    previous = sinks.published(spark, root).get(COUNTS, spark.createDataFrame([], "dataset string, rows long"))
    checks = materialise(quality.check_datasets(tables, REQUIRED, FLOORS, previous))
    if checks.where(~F.col("ok")).count() == 0:
        good = {n: df for n, df in tables.items() if df is not None}
        if "wage_index" in good and "payroll" in good:
            good["wage_index"] = extended_wages(good["wage_index"], good["payroll"])
        good = {n: readers.snake_columns(df) for n, df in good.items()}
        good["metadata"] = sinks.metadata(spark, {"datasets": str(len(paths))})
        good["last_updated"] = sinks.last_updated(spark, sorted(paths))
        good[COUNTS] = quality.accepted(checks)
        run = sinks.publish(spark, good, root)
        if database:
            spark.sql(f"create database if not exists {database}")
            for name in good:
                spark.sql(f"create or replace view {database}.{name} as select * from parquet.`{root}/runs/{run}/{name}`")
    return checks
