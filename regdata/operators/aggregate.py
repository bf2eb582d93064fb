"""Grouped statistics with the missing-value rules of the reports."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.functions.nulls import known_keys, sum0
from regdata.vocab import (
    AMOUNT_FROM, BUDGET, BUDGET_NO_FUND, BUDGET_WITH_FUND, FUND_AMOUNT, FUND_QUESTION, FUND_REPORTED, PERCENT_FROM,
)


def count_rows(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return known_keys(df, *by).groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def count_known(df: DataFrame, by: list[str], col: str, name: str = "n") -> DataFrame:
    return known_keys(df, *by).groupBy(*by).agg(F.count(col).alias(name))


def sum_by(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return known_keys(df, *by).groupBy(*by).agg(*[sum0(c).alias(c) for c in cols])


def rollup_mixed(df: DataFrame, by: list[str], sums: list[str], counts: dict[str, str], picks: list[str]) -> DataFrame:
    """Sum some columns, count others, keep one value of the rest (the smallest, so that runs agree)."""
    aggs = [sum0(c).alias(c) for c in sums]
    aggs += [F.count(F.lit(1)).alias(out) for out in counts.values()]
    aggs += [pick_non_null(c).alias(c) for c in picks]
    return known_keys(df, *by).groupBy(*by).agg(*aggs)


def pick_non_null(col: str) -> Column:
    return F.min(col)


def share_of(cond: Column, ndigits: int | None = None) -> Column:
    """Percent of rows that meet a condition; unknown counts as not met."""
    out = F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100
    return F.round(out, ndigits) if ndigits is not None else out


def mean_of(total: str, count: str) -> Column:
    """Sum of one column over the number of values of another."""
    return F.try_divide(sum0(total), F.count(count))


def weighted_mean(df: DataFrame, by: list[str], cols: list[str], weight: str, null_policy: str = "match") -> DataFrame:
    """Weighted mean of several columns in one pass.

    ``match`` leaves the weight of a missing value in the denominator, as the published
    tables do; ``strict`` counts only weights whose value is present.
    """
    w = F.col(weight)
    aggs = []
    for c in cols:
        base = w if null_policy == "match" else F.when(F.col(c).isNotNull(), w)
        aggs.append(F.try_divide(sum0(w * F.col(c)), F.sum(base)).alias(c))
    return known_keys(df, *by).groupBy(*by).agg(*aggs)


def smooth(pairs: DataFrame, area: str, source: str, cols: list[str]) -> DataFrame:
    """Mean over the sources near an area, each weighted by the number of areas it touches.

    Also counts the sources of an area. The weights come from an aggregate joined back,
    not from a window over a source: adaptive execution splits the join when one source
    holds many pairs.
    """
    touched = known_keys(pairs, source).groupBy(source).agg(F.count(area).alias("_dup"))
    weighted = pairs.join(touched, source, "left")
    aggs = [F.try_divide(F.sum(F.col(c) * F.col("_dup")), F.sum("_dup")).alias(c) for c in cols]
    return known_keys(weighted, area).groupBy(area).agg(*aggs, F.count(source).alias("n_sources"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: ``n``, ``r`` and the two-sided ``p``.

    Spark computes r; p comes from that one row by the incomplete beta function.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = F.stddev_pop(x) * F.stddev_pop(y)  # 0 for a constant column, where there is no r
    stats = both.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop(x, y), spread).alias("r"))
    return stats.withColumn("p", _two_sided_p(F.col("r"), F.col("n")))


def _two_sided_p(r: Column, n: Column) -> Column:
    """p of a correlation on n pairs: the regularised incomplete beta I(1 - r^2; (n - 2) / 2, 1/2).

    One aggregate row passes through here; the continued fraction has no native form.
    """

    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        def fraction(x, a, b):
            tiny, c = 1e-300, 1.0
            d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
            h = d
            for m in range(1, 2000):
                for term in (
                    m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
                ):
                    d = 1 / ((1 + term * d) or tiny)
                    c = (1 + term / c) or tiny
                    h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            return h

        def beta(x, a, b):
            log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
            if x > (a + 1) / (a + b + 2):
                return 1 - math.exp(log_front) * fraction(1 - x, b, a) / b
            return math.exp(log_front) * fraction(x, a, b) / a

        out = []
        for ri, ni in zip(r, n):
            if ri is None or ri != ri or ni < 3:
                out.append(None)
            else:
                x = 1 - ri * ri
                out.append(0.0 if x <= 0 else 1.0 if x >= 1 else beta(x, (ni - 2) / 2, 0.5))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(p_value, T.DoubleType())(r, n.cast("double"))


def row_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Largest of the values that share a key (columns collapsed to one year, say).

    Text compares as a number where it is one.
    """
    order = F.struct(F.col(value).try_cast("double"), F.col(value))
    return df.groupBy(*by).agg(F.max_by(value, order).alias(value))


def derive_budget_rows(df: DataFrame) -> DataFrame:
    """Add derived rows to (state, year, detail, value text) budget rows.

    Per state and year: the budget with and without the revolving fund, from whichever
    of the three report layouts is present, then an amount for every percentage and a
    percentage for every amount. The input is read once: repeated rows are counted, the few different
    ones of a state and year meet in one row, and that emits itself and what follows from it.
    """
    counted = df.groupBy("state", "year", "detail", "value").agg(F.count(F.lit(1)).cast("int").alias("times"))
    one = counted.groupBy("state", "year").agg(F.collect_list(F.struct("detail", "value", "times")).alias("_rows"))

    def values(detail: Column | str, number: bool) -> Column:
        own = F.filter("_rows", lambda r: r["detail"] == detail)
        return F.array_min(F.transform(own, lambda r: r["value"].try_cast("double") if number else r["value"]))

    has = lambda name: F.exists("_rows", lambda r: F.coalesce(r["detail"] == name, F.lit(False)))
    one = one.select(
        "*", has(BUDGET_WITH_FUND).alias("_l12"), has(FUND_REPORTED).alias("_l17"), has(FUND_QUESTION).alias("_l10"),
        values(BUDGET_WITH_FUND, True).alias("_with"), values(FUND_AMOUNT, True).alias("_fund"),
        values(BUDGET, True).alias("_plain"), values(FUND_REPORTED, True).alias("_reported"),
        F.coalesce(values(FUND_QUESTION, False) == "Yes", F.lit(False)).alias("_yes"),
    ).withColumn("_budget", F.when(F.col("_l12"), F.col("_with")).otherwise(F.col("_plain")))
    l12, l17, l10, yes, with_fund, plain = (F.col(c) for c in ("_l12", "_l17", "_l10", "_yes", "_with", "_plain"))
    no_fund = F.when(l12, with_fund - F.col("_fund")).when(l17, plain - F.col("_reported")).when(l10 & ~yes, plain)
    with_all = F.when(l12, with_fund).when(l17, plain).when(l10 & yes, plain)
    row = lambda detail, value: F.struct(detail.alias("detail"), value.cast("string").alias("value"))

    def share(detail: Column) -> Column:
        number, is_pct = values(detail, True), detail.startswith(PERCENT_FROM)
        amount = F.round(number / 100.0 * F.col("_budget"), 2)
        percent = F.round(F.try_divide(number, F.col("_budget")) * 100.0, 2)
        other = F.when(is_pct, F.replace(detail, F.lit(PERCENT_FROM), F.lit(AMOUNT_FROM))).otherwise(F.replace(detail, F.lit(AMOUNT_FROM), F.lit(PERCENT_FROM)))
        return row(other, F.when(is_pct, amount).otherwise(percent))

    own = F.flatten(F.transform("_rows", lambda r: F.array_repeat(row(r["detail"], r["value"]), r["times"])))
    none = F.filter(own, lambda r: F.lit(False))
    totals = F.when(l12 | l17 | l10, F.array(row(F.lit(BUDGET_NO_FUND), no_fund), row(F.lit(BUDGET), with_all))).otherwise(none)
    named = F.array_distinct(F.transform("_rows", lambda r: r["detail"]))
    named = F.filter(named, lambda d: d.startswith(PERCENT_FROM) | d.startswith(AMOUNT_FROM))
    keyed = F.col("state").isNotNull() & F.col("year").isNotNull()
    shares = F.when(keyed, F.transform(named, share)).otherwise(none)
    return one.select("state", "year", F.inline(F.concat(own, totals, shares)))
