"""Cleaning of numbers, dates, labels and names as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regdata.vocab import FEDERAL_ALIAS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col) -> Column:
    """NaN means missing in the sources; Spark would sort and sum it as a value."""
    return F.when(~F.isnan(_c(col)), _c(col))


def safe_double(col) -> Column:
    """Number or null: text such as ``Not Monitored`` gives null."""
    return _c(col).try_cast("double")


def clean_number(col) -> Column:
    """``$1,234.50`` or ``4.26%`` to a double, null when not a number."""
    return F.regexp_replace(F.trim(_c(col)), "[,$%]", "").try_cast("double")


def sentinel_to_null(col, *sentinels) -> Column:
    """Stored placeholder values (an unknown income, say) to null."""
    out = _c(col)
    for value in sentinels:
        out = F.nullif(out, F.lit(value))
    return out


def parse_timestamp(col) -> Column:
    """ISO date or timestamp, with or without fractions of a second, null when malformed."""
    return _c(col).try_cast("timestamp_ntz")  # wall-clock time, whatever the session's zone


def month_floor(col) -> Column:
    return F.date_trunc("month", _c(col)).cast("date")


def date_between(col, start, end, end_inclusive_day: bool = False) -> Column:
    """Inclusive range; ``end`` means midnight of that day unless ``end_inclusive_day``."""
    start, end = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    if end_inclusive_day:
        return (_c(col) >= start) & (_c(col) < end + F.expr("interval 1 day"))
    return (_c(col) >= start) & (_c(col) <= end)


def fiscal_year(label) -> Column:
    """``FY95 Gov`` style label: 2000 plus its two-digit year."""
    return (2000 + F.right(F.split_part(_c(label), F.lit(" "), F.lit(1)), F.lit(2)).try_cast("int")).cast("int")


def governor_flag(label) -> Column:
    return F.contains(_c(label), F.lit("Gov")).cast("int")


def report_year(label) -> Column:
    """``FY 2010-2011`` and ``FY2011`` both give 2011."""
    return F.nullif(F.regexp_extract(F.trim(_c(label)), "([0-9]{4})$", 1), F.lit("")).cast("int")


def split_name(col) -> Column:
    """``Last, First M.`` as struct(first, middle_initial, last)."""
    parts = F.split(_c(col), ", ")
    given = F.split(F.trim(F.try_element_at(parts, F.lit(2))), r"\s+")
    middle = F.when(
        F.size(given) > 1, F.regexp_replace(F.try_element_at(given, F.lit(-1)), r"\.", "")
    )
    return F.struct(
        F.try_element_at(given, F.lit(1)).alias("first"),
        middle.alias("middle_initial"),
        F.try_element_at(parts, F.lit(1)).alias("last"),
    )


def municipality_name(col) -> Column:
    """Drop the county part and the designation words of a census place name."""
    return F.regexp_replace(F.split_part(_c(col), F.lit(", "), F.lit(1)), " CDP| city| town", "")


def budget_label(col) -> Column:
    """One spelling per budget row name."""
    out = F.regexp_replace(_c(col), "\n", " ")
    out = F.trim(F.regexp_replace(out, "  ", " "))
    out = F.regexp_replace(out, r"Env\.", "Environmental")
    out = F.regexp_replace(out, "%", "Percent")
    return F.replace(out, F.lit(FEDERAL_ALIAS[0]), F.lit(FEDERAL_ALIAS[1]))


def city_and_watershed(col) -> Column:
    """``City (Watershed)`` as struct(city, watershed); no bracket or ``N/A`` gives nulls."""
    value = F.nullif(_c(col), F.lit("N/A"))
    inside = F.regexp_extract(value, r"\(([^(]*).$", 1)
    return F.struct(
        F.trim(F.split_part(value, F.lit(" ("), F.lit(1))).alias("city"),
        F.when(F.contains(value, F.lit("(")), F.trim(inside)).alias("watershed"),
    )


def comment_period(col) -> Column:
    """``start - end (Extended x)`` as struct(start, end, extension)."""
    value = F.nullif(_c(col), F.lit("N/A"))
    value = F.when(F.contains(value, F.lit("-")), value)
    last_word = F.substring_index(F.trim(value), " ", -1)
    return F.struct(
        F.trim(F.split_part(value, F.lit("-"), F.lit(1))).alias("start"),
        F.trim(F.split_part(F.split_part(value, F.lit("-"), F.lit(2)), F.lit(" ("), F.lit(1))).alias("end"),
        F.when(value.rlike("Extended|Re-opening"), F.left(last_word, F.length(last_word) - 1)).alias("extension"),
    )


def one_significant_digit(col) -> Column:
    """Round a positive number to its leading digit."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(_c(col))))
    return F.when(_c(col) > 0, F.round(F.try_divide(_c(col), scale)) * scale)


def rate(numerator, denominator, per: float = 1.0) -> Column:
    """``numerator / denominator * per``, null instead of an error when the base is 0."""
    return F.try_divide(_c(numerator) * F.lit(float(per)), _c(denominator))


def doubling_ratio(beta) -> Column:
    return F.pow(F.lit(2.0), _c(beta))
