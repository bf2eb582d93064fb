"""The missing-value rules of the reports, stated once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose grouping keys are all present: a missing key forms no group."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) if keys else df


def sum0(col) -> Column:
    """Sum that is 0, not null, for a group without values."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Join condition under which missing keys match each other."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def nans_to_nulls(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating column (apply once, at the scan)."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df
