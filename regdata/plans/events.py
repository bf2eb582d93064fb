"""Reports on reported overflow incidents and on inspections and tests.

``incidents`` has ``incident_id``, ``incident_date``, ``event_type``, ``reporter_class``,
``operator``, ``outfall_id``, ``latitude``, ``longitude``, ``water_body`` and ``volume``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdata.functions.clean import date_between, month_floor
from regdata.functions.nulls import known_keys, sum0
from regdata.operators import aggregate, quantile, relate, series


def verified(incidents: DataFrame, start, end, report_class: str = "Verified Data Report", end_inclusive_day: bool = False) -> DataFrame:
    """Reports of one class inside a date range; ``end`` is its midnight unless ``end_inclusive_day``."""
    return incidents.where(date_between("incident_date", start, end, end_inclusive_day) & (F.col("reporter_class") == report_class))


def _by_type(df: DataFrame, key: str, spine: DataFrame, agg, name: str, fill) -> DataFrame:
    types = relate.distinct_values(df, "event_type")
    per = known_keys(df, key, "event_type").groupBy(key, "event_type").agg(agg.alias(name))
    return relate.align_to_spine(per, relate.spine_of(spine, {"event_type": types}), [key, "event_type"], {name: fill})


def events_per_month(reports: DataFrame, start: str, end: str) -> DataFrame:
    months = series.month_spine(reports.sparkSession, start, end)
    dated = reports.withColumn("month", month_floor("incident_date"))
    return _by_type(dated, "month", months, F.count(F.lit(1)), "n", 0)


def volume_per_month(reports: DataFrame, start: str, end: str) -> DataFrame:
    """Millions of gallons."""
    months = series.month_spine(reports.sparkSession, start, end)
    dated = reports.withColumn("month", month_floor("incident_date"))
    return _by_type(dated, "month", months, sum0("volume") / 1e6, "volume_m", 0.0)


def volume_per_operator(reports: DataFrame) -> DataFrame:
    operators = reports.select("operator").where("operator is not null").distinct()
    return _by_type(reports, "operator", operators, sum0("volume") / 1e6, "volume_m", 0.0)


def volume_per_water_body(reports: DataFrame, top: int = 20) -> DataFrame:
    """Only the ``top`` water bodies by volume."""
    per = series.top_keys_detail(reports, "water_body", ["event_type"], "volume", top)
    types = relate.distinct_values(reports, "event_type")
    spine = relate.spine_of(per.select("water_body").distinct(), {"event_type": types})
    full = relate.align_to_spine(per, spine, ["water_body", "event_type"], {"volume": 0.0})
    return full.select("water_body", "event_type", (F.col("volume") / 1e6).alias("volume_m"))


def reporting_rates(reports: DataFrame) -> DataFrame:
    """Percent of reports with a volume above zero, and with one rounded to thousands."""
    return known_keys(reports, "event_type").groupBy("event_type").agg(
        aggregate.share_of(F.col("volume") > 0).alias("nonzero_pct"),
        aggregate.share_of(F.col("volume") % 1000 == 0).alias("modelled_pct"),
    )


def outfall_rollup(reports: DataFrame, outfalls: DataFrame) -> DataFrame:
    """One row per outfall place: volume in millions, number of reports, descriptive columns.

    Missing coordinates are filled from the reference list; an outfall name may stand for
    several places, so coordinates are part of the key.
    """
    filled = relate.lookup_fill(reports, outfalls, "outfall_id", {"latitude": "lat", "longitude": "long"})
    out = aggregate.rollup_mixed(
        filled, ["reporter_class", "outfall_id", "latitude", "longitude"], ["volume"], {"incident_id": "n"}, ["operator", "water_body"]
    )
    return out.withColumn("volume", F.col("volume") / 1e6)


def inspections_per_town(inspections: DataFrame, towns: DataFrame) -> DataFrame:
    """Inspections per town; towns without any stay with 0."""
    return relate.align_to_spine(aggregate.count_rows(inspections, ["town"]), towns.select("town").distinct(), ["town"], {"n": 0})


def class_breaks(df: DataFrame, col: str, probs: list[float], positive: bool = False) -> DataFrame:
    """Map class breaks of a column, optionally of its positive values only."""
    return quantile.quantiles(df.where(F.col(col) > 0) if positive else df, [], col, probs)


def tests_per_year(tests: DataFrame) -> DataFrame:
    """Results per year, contaminant group, raw or finished, and water system."""
    dated = tests.withColumn("year", F.year("collected"))
    return aggregate.count_known(dated, ["year", "contaminant_group", "raw_or_finished", "system"], "result")
