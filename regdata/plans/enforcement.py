"""Reports on enforcement actions.

``actions`` has ``id``, ``year``, ``text``, ``fine`` (null when none) and, where towns
matter, ``municipality`` (array of names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdata.functions.clean import rate
from regdata.functions.nulls import sum0
from regdata.functions.text import dollar_range, title_of_flag
from regdata.operators import aggregate, quantile, relate, resample, series
from regdata.session import materialise
from regdata.vocab import BAND_SD


def actions_per_year(actions: DataFrame) -> DataFrame:
    return aggregate.count_rows(actions, ["year"])


def penalties_per_year(actions: DataFrame) -> DataFrame:
    """Sum of penalties in millions."""
    return actions.where("year is not null").groupBy("year").agg((sum0("fine") / 1e6).alias("penalties_m"))


def ranked_penalties(actions: DataFrame) -> DataFrame:
    """k-th largest penalty of each year in millions; rows with any gap are left out first."""
    ranked = series.ranked_values(actions.na.drop(), "year", "fine", "id")
    return ranked.select("year", "k", (F.col("value") / 1e6).alias("penalty_m"))


def actions_and_funding(actions: DataFrame, funding: DataFrame) -> DataFrame:
    """Actions per year beside the administrative budget in millions; every year must be funded."""
    counts = actions_per_year(actions)
    joined = relate.strict_lookup(counts, funding, ["year"], "admin_budget")
    return joined.select("year", "n", (F.col("admin_budget") / 1e6).alias("budget_m"))


def funding_correlation(actions: DataFrame, funding: DataFrame) -> DataFrame:
    """One row: n, r and p of actions against budget."""
    return aggregate.pearson(actions_and_funding(actions, funding), "n", "budget_m")


def topic_shares(flagged: DataFrame, flags: list[str]) -> DataFrame:
    """Percent of each year's actions per keyword flag, in long form."""
    counts = flagged.where("year is not null").groupBy("year").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(flags)]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(f"_f{i}").alias("hits")) for i, c in enumerate(flags)])
    long = counts.select("year", "_n", F.inline(pairs))
    return long.select(
        "year", "flag", title_of_flag("flag").alias("topic"), "hits", (F.col("hits") * 100.0 / F.col("_n")).alias("pct")
    )


def topic_facts(flagged: DataFrame, flags: list[str], first_year: int, last_year: int) -> DataFrame:
    """Per flag: mean hits and mean percent over full years, first and last named year, drop from the peak."""
    shares = topic_shares(flagged, flags)
    full = F.col("year") < shares.agg(F.max("year")).scalar()
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("pct")))
    return shares.groupBy("flag").agg(
        F.avg(F.when(full, F.col("hits"))).alias("yearly_hits"),
        F.avg(F.when(full, F.col("pct"))).alias("yearly_pct"),
        at(first_year).alias("first_pct"), at(last_year).alias("last_pct"),
        ((1 - F.try_divide(at(last_year), F.max("pct"))) * 100).alias("drop_from_peak_pct"),
    )


def penalty_histogram(actions: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """Number of penalties on doubling edges, with display labels."""
    h = quantile.histogram(actions, "fine", edges or quantile.doubling_edges())
    return h.select("bin", dollar_range(F.col("low"), F.col("high")).alias("label"), "n")


def median_penalty(actions: DataFrame, reps: int = 1000, seed: int = 0, drop_null_first: bool = False) -> DataFrame:
    """Median penalty per full year with its 90% bootstrap interval."""
    full = series.without_last_period(actions, "year")
    return resample.bootstrap_ci(full, ["year"], "fine", "median", reps, [0.05, 0.5, 0.95], ["low", "median", "high"], seed, drop_null_first)


def orders_with_penalty(flagged: DataFrame, order_flag: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Percent of flagged orders that carry a penalty, with its 90% bootstrap interval."""
    orders = flagged.where(F.col(f"`{order_flag}`"))
    return resample.bootstrap_ci(
        orders, ["year"], F.col("fine") > 0, "share", reps, [0.05, 0.5, 0.95], ["low", "pct", "high"], seed, scale=100.0
    )


def orders_with_penalty_counts(flagged: DataFrame, order_flag: str) -> DataFrame:
    """The counts behind :func:`orders_with_penalty`."""
    orders = flagged.where(F.col(f"`{order_flag}`") & F.col("year").isNotNull())
    return orders.groupBy("year").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("fine") > 0).alias("with_penalty"),
        aggregate.share_of(F.col("fine") > 0).alias("pct"),
    )


def town_summary(actions: DataFrame, census: DataFrame) -> DataFrame:
    """Actions and penalties per census town with rates; an action counts in full for each town it names."""
    totals = relate.member_totals(actions, "municipality", census, "town", "fine")
    joined = census.select("town", "population", "income").join(totals, "town", "left")
    return joined.select(
        "town", "population", (F.col("income") / 1000).alias("income_k"), "n", (F.col("fine") / 1000).alias("penalties_k"),
        rate("n", "population", 1e5).alias("actions_per_100k"), rate(F.col("fine") / 1e6, "population", 1e5).alias("penalties_m_per_100k"),
    )


def top_actions_per_town(actions: DataFrame, k: int = 3) -> DataFrame:
    """Largest penalties of each town, actions without one last."""
    named = actions.select("id", "year", "fine", "text", F.explode(F.array_distinct("municipality")).alias("town"))
    return series.top_per_group(named, "town", [F.desc_nulls_last("fine"), F.asc("id")], k, "place")


def rate_by_income(summary: DataFrame, bins: int = 8, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Population-weighted mean action rate per income bin with a resampled band.

    ``summary`` is :func:`town_summary` with a whole-number ``key`` per town.
    """
    summary = materialise(summary)  # one row per town, read by every step below
    binned = quantile.quantile_bin(summary, "income_k", bins, centre="income_centre")
    means = resample.wmean_bootstrap(binned, ["bin", "income_centre"], "actions_per_100k", "population", "key", reps, seed, band=BAND_SD)
    return means.orderBy("bin")


def top_towns(summary: DataFrame, by: str, n: int = 5, min_population: float = 25000) -> DataFrame:
    """Large towns with the highest rate."""
    return series.top_rows(summary, F.col("population") > min_population, [F.desc(by), F.asc("town")], n)
