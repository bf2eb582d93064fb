"""Dataset checks: presence, columns, row floors, no shrinking; counts are kept only if all pass."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNREADABLE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def load_or_none(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The dataset, or None when it is missing or has no readable schema; any other failure is raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() in UNREADABLE:
            return None
        raise


def count_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    """Records per dataset; one scan each, no column is read."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def missing_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> dict[str, list[str]]:
    """Required columns each dataset lacks; extra columns are fine."""
    return {n: sorted(set(required.get(n, [])) - set(df.columns)) for n, df in tables.items()}


def check_datasets(
    tables: dict[str, DataFrame | None], required: dict[str, list[str]], floors: dict[str, int], previous: DataFrame,
) -> DataFrame:
    """One row per dataset: rows, previous rows, each check, and ``ok``."""
    spark = previous.sparkSession
    present = {n: df for n, df in tables.items() if df is not None}
    lacking = missing_columns(present, required)
    rules = [
        (n, n in present, ",".join(lacking.get(n, [])), int(floors.get(n, 1))) for n in tables
    ]
    base = spark.createDataFrame(rules, "dataset string, readable boolean, missing string, floor long")
    if present:
        base = base.join(count_datasets(present), "dataset", "left")
    else:
        base = base.withColumn("rows", F.lit(None).cast("long"))
    before = previous.select("dataset", F.col("rows").alias("previous_rows"))
    out = base.join(before, "dataset", "left")
    return out.withColumns({
        "columns_ok": F.col("missing") == "",
        "floor_ok": F.coalesce(F.col("rows") >= F.col("floor"), F.lit(False)),
        "growth_ok": F.coalesce(F.col("rows") >= F.coalesce("previous_rows", F.lit(0)), F.lit(False)),
    }).withColumn("ok", F.col("readable") & F.col("columns_ok") & F.col("floor_ok") & F.col("growth_ok"))


def accepted(checks: DataFrame) -> DataFrame:
    """The new counts, with the time they were accepted."""
    return checks.select("dataset", "rows", F.current_timestamp().alias("run_ts"))


def accept(checks: DataFrame, path: str) -> bool:
    """Write the new counts if, and only if, every check passed."""
    failed = checks.where(~F.coalesce("ok", F.lit(False))).limit(1).count()
    if failed:
        return False
    accepted(checks).write.mode("overwrite").parquet(path)
    return True


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: number of missing values per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
