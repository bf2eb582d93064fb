"""Reports on agency budgets.

``history`` holds (``state``, ``year``, ``detail``, ``value`` as text); ``wages`` (``year``,
``awi``); ``population`` (``state``, ``year``, ``people``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdata.functions.clean import budget_label, clean_number, fiscal_year, governor_flag, rate, report_year
from regdata.operators import aggregate, relate, series
from regdata.vocab import BUDGET, PERCENT_FROM


def _detail(history: DataFrame, detail: str) -> DataFrame:
    """One number per state and year; a repeated row keeps the largest."""
    rows = history.where((F.col("detail") == detail) & F.col("year").isNotNull())
    return rows.groupBy("state", "year").agg(F.max(clean_number("value")).alias("value"))


def _every_year(df: DataFrame, history: DataFrame) -> DataFrame:
    """States with the detail, on all years of the history."""
    years = relate.distinct_values(history, "year")
    return relate.align_to_spine(df, relate.spine_of(df.select("state").distinct(), {"year": years}), ["state", "year"])


def state_budgets(history: DataFrame, wages: DataFrame, base: int) -> DataFrame:
    """Budget per state and year in millions of ``base``-year money, gaps null."""
    full = _every_year(_detail(history, BUDGET), history)
    real = series.deflate(full, wages, "year", "awi", base, ["value"])
    return real.select("state", "year", (F.col("value") / 1e6).alias("budget_m"))


def state_budgets_per_capita(history: DataFrame, wages: DataFrame, population: DataFrame, base: int) -> DataFrame:
    """The same per head, in thousands."""
    full = state_budgets(history, wages, base).join(population, ["state", "year"], "left")
    return full.select("state", "year", rate(F.col("budget_m") * 1000, "people").alias("budget_k_per_head"))


def federal_share(history: DataFrame) -> DataFrame:
    """Percent of each state's budget that is federal."""
    detail = PERCENT_FROM + "Federal Government"
    return _every_year(_detail(history, detail), history).withColumnRenamed("value", "federal_pct")


def budget_summary(labels: DataFrame) -> DataFrame:
    """Fiscal-year labels with comma numbers as a sorted series in millions."""
    return labels.select(
        "label", fiscal_year("label").alias("year"), governor_flag("label").alias("governor"),
        (clean_number("total") / 1e6).alias("total_m"),
    ).orderBy("year", "label")


def line_item_summary(labels: DataFrame, items: DataFrame, item: str, years: list[str]) -> DataFrame:
    """The summary with one line item's year columns turned into a column."""
    series_rows = relate.line_item_series(items, "item", item, years, "label", "admin")
    return budget_summary(labels).join(series_rows, "label", "left").withColumn("admin", clean_number("admin"))


def wage_series(wages: DataFrame, last_year, carry: list[str], zero: list[str]) -> DataFrame:
    """Wage index carried forward to the last year other tables reach."""
    return series.extend_yearly(wages, "year", last_year, carry, zero)


def unified_history(vintages: list[DataFrame], prefer: str = "later") -> DataFrame:
    """One budget history out of parsed report files, oldest first.

    Each file gives (``unit``, ``detail``, ``column``, ``value``) as :func:`parse_blocks` does. Per
    file, columns that stand for the same fiscal year collapse to the larger value;
    across files one edition wins; then budgets, amounts and percentages are derived.
    """
    cleaned = []
    for rows in vintages:
        value = F.regexp_replace("value", "[%,$]", "")
        one = rows.select(
            F.col("unit").alias("state"), report_year("column").alias("year"), budget_label("detail").alias("detail"), value.alias("value")
        )
        cleaned.append(aggregate.row_max(one.where("value <> '' and year is not null"), ["state", "year", "detail"], "value"))
    merged = relate.merge_vintages(cleaned, ["state", "year", "detail"], "value", prefer)
    return aggregate.derive_budget_rows(merged)


def state_population(decade: DataFrame, recent: DataFrame, years: list[str], recent_years: list[str]) -> DataFrame:
    """Two wide population tables as one long (state, year, people)."""
    joined = decade.na.drop(subset=["state"]).join(recent.na.drop(subset=["state"]), "state", "inner")
    long = relate.wide_to_long(joined, ["state"], [*years, *recent_years], "year", "people", "string")
    return long.select("state", F.col("year").cast("int").alias("year"), clean_number("people").alias("people")).na.drop(subset=["people"])
