"""Reports on staff: ``staff`` (yearly records), ``payroll`` (comptroller's records), ``wages`` (index)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdata.functions.nulls import sum0
from regdata.functions.text import classify
from regdata.operators import aggregate, relate, series
from regdata.vocab import HEADCOUNT_CLASSES, JOB_CLASSES, OTHER_CLASS, WAGE_CLASSES


def combined(staff: DataFrame, payroll: DataFrame) -> DataFrame:
    """Both sources side by side, year and earnings filled from the payroll where missing."""
    both = relate.full_outer_coalesced(
        staff, payroll, [("calendar_year", "year"), ("name_first", "name_first"), ("name_last", "name_last")]
    ).withColumnRenamed("calendar_year", "year")
    return both.withColumn("earnings", F.coalesce("earnings", "pay_total")).withColumn(
        "bought_out", F.coalesce(F.col("pay_buyout") > 0, F.lit(False))
    )


def staff_per_year(both: DataFrame, full_time: str = "Full Time Employee") -> DataFrame:
    """Paid records per year and those of full-time position."""
    known = both.where("year is not null")
    return known.groupBy("year").agg(
        F.count("earnings").alias("staff"),
        F.count(F.when(F.col("position_type") == full_time, F.col("earnings"))).alias("full_time"),
    )


def staff_and_funding(both: DataFrame, funding: DataFrame) -> DataFrame:
    joined = relate.strict_lookup(staff_per_year(both), funding, ["year"], "admin_budget")
    return joined.select("year", "staff", (F.col("admin_budget") / 1e6).alias("budget_m"))


def staff_correlation(both: DataFrame, funding: DataFrame) -> DataFrame:
    """One row: 100 r and 100 p of staff against budget."""
    fact = aggregate.pearson(staff_and_funding(both, funding), "staff", "budget_m")
    return fact.select("n", (F.col("r") * 100).alias("r_pct"), (F.col("p") * 100).alias("p_pct"))


def buyouts(both: DataFrame, wages: DataFrame, base: int, direction: str = "divide") -> DataFrame:
    """Buy-out cost per year in millions of ``base``-year money, and the number of people.

    ``direction="multiply"`` gives the published series.
    """
    per_year = both.where("year is not null").groupBy("year").agg(
        (sum0("pay_buyout") / 1e6).alias("cost_m"), F.count_if("bought_out").alias("people")
    )
    return series.deflate(per_year, wages, "year", "awi", base, ["cost_m"], direction)


def with_job_class(staff: DataFrame) -> DataFrame:
    return staff.withColumn("job_class", classify("job_title", JOB_CLASSES, OTHER_CLASS))


def _class_years(staff: DataFrame, years: DataFrame, classes: list[str], aggs: list) -> DataFrame:
    per = staff.where(F.col("job_class").isin(classes)).groupBy("job_class", F.col("calendar_year").alias("year")).agg(*aggs)
    return relate.align_to_spine(per, relate.spine_of(years, {"job_class": classes}), ["year", "job_class"])


def mean_wages(staff: DataFrame, years: DataFrame, wages: DataFrame, base: int) -> DataFrame:
    """Mean earnings in thousands per job class and year, nominal and in ``base``-year money."""
    per = _class_years(staff, years, WAGE_CLASSES, [(aggregate.mean_of("earnings", "earnings") / 1000).alias("nominal_k")])
    return series.deflate(per.withColumn("real_k", F.col("nominal_k")), wages, "year", "awi", base, ["real_k"])


def seniority_gain(staff: DataFrame, years: DataFrame) -> DataFrame:
    """Mean seniority per class beyond the years elapsed.

    The mean is the seniority of all records over the number of paid ones.
    """
    per = _class_years(staff, years, WAGE_CLASSES, [aggregate.mean_of("seniority", "earnings").alias("mean_seniority")])
    return series.excess_over_elapsed(per, "year", "mean_seniority", "gain")


def headcount_index(staff: DataFrame, years: DataFrame) -> DataFrame:
    """Paid records per class, first year = 100."""
    per = staff.where(F.col("job_class").isin(HEADCOUNT_CLASSES)).groupBy("job_class", F.col("calendar_year").alias("year")).agg(
        F.count("earnings").alias("n")
    )
    return series.index_to_first(per, "job_class", "year", "n", years, HEADCOUNT_CLASSES)
