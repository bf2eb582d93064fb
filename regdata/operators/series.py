"""Yearly and monthly series: spines, ranks, index numbers, deflation, carry-forward, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdata.functions.nulls import known_keys
from regdata.operators.ordered import positions
from regdata.operators.relate import align_to_spine, spine_of


def month_spine(spark, start: str, end: str, name: str = "month") -> DataFrame:
    """Month starts inside [start, end]."""
    first = F.date_trunc("month", F.date_add(F.add_months(F.lit(start).cast("date"), 1), -1)).cast("date")
    return spark.range(1).select(
        F.explode(F.sequence(first, F.lit(end).cast("date"), F.expr("interval 1 month"))).alias(name)
    )


def day_spine(spark, start: str, end: str, name: str = "day") -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias(name)
    )


def without_last_period(df: DataFrame, period: str) -> DataFrame:
    """Leave out the newest, partial period."""
    return df.where(F.col(period) < df.agg(F.max(period)).scalar())


def seniority(df: DataFrame, name: str, year: str, tie: str, out: str = "seniority") -> DataFrame:
    """0-based number of earlier records under the same name, by year then ``tie``.

    A name (blank or default) on a third of all rows is numbered by a third of the tasks.
    """
    return positions(known_keys(df, name), [name], [year, tie], out)


def rank_by_value(df: DataFrame, by: list[str], value: str, tie: str, out: str = "rank") -> DataFrame:
    """0-based rank of each row in its group, largest value first, ties by ``tie``.

    Neither a group nor a value that repeats often ends up in one task: see :func:`positions`.
    """
    return positions(known_keys(df, *by, value), by, [F.desc(value), F.asc(tie)], out)


def ranked_values(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """k-th largest value of every group for k = 0 .. largest group - 1, and 0 past a group's end.

    Values are ranked once; the padding is made from one row per group.
    """
    ranked = rank_by_value(df, [by], value, tie, "k").select(by, "k", F.col(value).alias("value"))
    sizes = known_keys(df, by).groupBy(by).agg(F.count(value).alias("_n"))
    longest = known_keys(df, by).groupBy(by).agg(F.count(value).alias("_n")).agg(F.max("_n")).scalar()
    # two-level sequence: chunks of 100,000 ranks become rows first, then single ranks
    pad = (
        sizes.withColumn("_m", longest).where("_n < _m")
        .withColumn("_from", F.explode(F.sequence("_n", F.col("_m") - 1, F.lit(100_000).cast("long"))))
        .withColumn("k", F.explode(F.sequence("_from", F.least(F.col("_from") + 99_999, F.col("_m") - 1))))
        .select(by, "k", F.lit(0.0).alias("value"))
    )
    return ranked.unionByName(pad)


def top_per_group(df: DataFrame, by: str, order: list[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows of each group. Spark limits every task to ``k`` per group before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return known_keys(df, by).withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def index_to_first(df: DataFrame, by: str, year: str, value: str, years: DataFrame, classes: Column | list, out: str = "idx") -> DataFrame:
    """Yearly series with the first spine year set to 100; null if a class is absent in that year.

    ``df`` holds one row per class and year.
    """
    spine = spine_of(years.select(year).distinct(), {by: classes})
    full = align_to_spine(df, spine, [by, year])
    w = Window.partitionBy(by).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return full.withColumn(out, F.try_divide(F.col(value) * 100.0, F.first(value).over(w)))


def excess_over_elapsed(df: DataFrame, year: str, value: str, out: str = "excess") -> DataFrame:
    """Value minus the years since the first year of the table."""
    first = df.agg(F.min(year)).scalar()
    return df.withColumn(out, F.col(value) - (F.col(year) - first))


def extend_yearly(df: DataFrame, year: str, last_year, carry: list[str], zero: list[str]) -> DataFrame:
    """Repeat the last row up to ``last_year`` (number or scalar subquery); ``zero`` columns become 0."""
    last = df.agg(F.max_by(F.struct(*carry), year).alias("_row"), F.max(year).alias("_y"))
    last = last.withColumn("_end", F.lit(last_year) if not isinstance(last_year, Column) else last_year)
    more = last.where(F.col("_end") > F.col("_y")).select(
        F.explode(F.sequence((F.col("_y") + 1).cast("int"), F.col("_end").cast("int"))).alias(year),
        *[F.col(f"_row.{c}").alias(c) for c in carry],
        *[F.lit(0).alias(c) for c in zero],
    )
    typed = more.select(*[F.col(f.name).cast(f.dataType) for f in df.select(year, *carry, *zero).schema])
    return df.select(year, *carry, *zero).unionByName(typed)


def deflator(index: DataFrame, year: str, level: str, base: int, direction: str = "divide", out: str = "factor") -> DataFrame:
    """Factor per year that turns money into ``base``-year money.

    ``divide`` (default) is level(base) / level(year); ``multiply`` is its inverse, which
    the published buy-out series uses.
    """
    base_level = index.where(F.col(year) == base).agg(F.max(level)).scalar()
    ratio = F.try_divide(base_level, F.col(level))
    if direction == "multiply":
        ratio = F.try_divide(F.col(level), base_level)
    return index.select(F.col(year), ratio.alias(out))


def deflate(df: DataFrame, index: DataFrame, year: str, level: str, base: int, cols: list[str], direction: str = "divide") -> DataFrame:
    """Convert money columns to ``base``-year money; years without an index give null."""
    factors = deflator(index, year, level, base, direction, "_factor")
    joined = df.join(factors, year, "left")
    return joined.withColumns({c: F.col(c) * F.col("_factor") for c in cols}).drop("_factor")


def top_keys_detail(df: DataFrame, key: str, by: list[str], value: str, n: int) -> DataFrame:
    """Totals per key and ``by``, for the ``n`` keys with the largest totals only."""
    grouped = known_keys(df, key, *by).groupBy(key, *by).agg(F.sum(value).alias(value))
    top = grouped.groupBy(key).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), key).limit(n)
    return grouped.join(F.broadcast(top.select(key)), key, "left_semi")  # n rows


def top_rows(df: DataFrame, cond: Column, order: list[Column], n: int) -> DataFrame:
    """Filter, drop rows with any null, first ``n`` in the given order."""
    return df.where(cond).na.drop().orderBy(*order).limit(n)
