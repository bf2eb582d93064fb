"""Power-law dose-response y ~ N(alpha * x**beta, sigma * sd(y) / sqrt(p)) by a grid posterior.

The data enter the posterior through four weighted sums per beta, so rows are read once
and added up map-side into one line per (group, beta); everything after that has the
size of the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regdata.functions.nulls import known_keys
from regdata.operators.skew import spread_out
from regdata.vocab import MIN_POPULATION

GRID = {"beta": (-4.0, 8.0, 0.05), "alpha": (1e-3, 60.0, 200), "sigma": (0.02, 12.0, 40)}


def populated(df: DataFrame, pop: str, floor: float = MIN_POPULATION) -> DataFrame:
    return df.where(F.col(pop) >= floor)


def excluded_report(df: DataFrame, by: list[str], y: str, pop: str, floor: float = MIN_POPULATION) -> DataFrame:
    """What the population floor leaves out: units, units with an outcome, and its total."""
    out = F.col(pop) < floor
    return known_keys(df, *by).groupBy(*by).agg(
        F.count_if(out).alias("units"),
        F.count_if(out & (F.col(y) > 0)).alias("units_with_outcome"),
        F.coalesce(F.sum(F.when(out, F.col(y))), F.lit(0.0)).alias("outcome"),
    )


def require_known(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail at run time on a missing input."""
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    first = cols[0]
    kind = df.schema[first].dataType
    guarded = F.when(missing, F.raise_error(F.lit("missing value in model input")).cast(kind)).otherwise(F.col(first))
    return df.withColumn(first, guarded)


def normalised_weights(df: DataFrame, by: list[str], pop: str, out: str = "p") -> DataFrame:
    """Population over its mean in the group."""
    means = df.groupBy(*by).agg(F.avg(pop).alias("_mean"))
    joined = df.join(means, by) if by else df.withColumn("_mean", means.scalar())
    return joined.withColumn(out, F.col(pop) / F.col("_mean")).drop("_mean")


def _log_grid(low: float, high: float, n: int):
    """n points from low to high, equal steps in the logarithm, as constant structs (v, log)."""
    step = math.log(high / low) / (n - 1)
    logs = [math.log(low) + i * step for i in range(n)]
    return F.array(*[F.struct(F.lit(math.exp(g)).alias("v"), F.lit(g).alias("log")) for g in logs])


def powerlaw_sums(df: DataFrame, by: list[str], x: str, y: str, pop: str, beta=GRID["beta"]) -> DataFrame:
    """Per group and beta: weighted sums, number of units and sd of the outcome.

    ``pop`` may be any positive multiple of the weights: it is divided by the group mean
    here. A unit with x = 0 has no finite prediction for negative beta; such betas get
    no line for that group.
    """
    lo, hi, step = beta
    steps = round((hi - lo) / step)
    base = known_keys(df, *by).select(
        *by, F.col(x).cast("double").alias("_x"), F.coalesce(F.col(y), F.lit(0.0)).alias("_y"), F.col(pop).cast("double").alias("_p")
    )
    scale = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("j"), F.stddev_samp("_y").alias("s"), F.avg("_p").alias("_mean"), F.min("_x").alias("_xmin"),
        F.sum(F.col("_p") * F.col("_y") * F.col("_y")).alias("_pyy"),
    )
    grid = base.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    b = F.lit(lo) + F.col("_i") * F.lit(step)
    power = F.when((F.col("_x") > 0) | (b >= 0), F.pow(F.col("_x"), b))
    grid = grid.withColumn("_q", power)
    sums = grid.groupBy(*by, "_i").agg(
        F.sum(F.col("_p") * F.col("_y") * F.col("_q")).alias("_pyq"),
        F.sum(F.col("_p") * F.col("_q") * F.col("_q")).alias("_pqq"),
    )
    joined = sums.join(scale, by)
    mean = F.col("_mean")
    return joined.where((F.col("_xmin") > 0) | (b >= 0)).select(
        *by, F.col("_i").alias("i"), b.alias("beta"), "j", "s",
        (F.col("_pyy") / mean).alias("syy"), (F.col("_pyq") / mean).alias("sxy"), (F.col("_pqq") / mean).alias("sxx"),
    )


def powerlaw_posterior(
    df: DataFrame, by: list[str], x: str, y: str, pop: str, probs: list[float] = [0.5, 0.05, 0.95],
    names: list[str] | None = None, grid: dict = GRID,
) -> DataFrame:
    """Posterior quantiles of the doubling ratio 2**beta per group."""
    if not by:
        raise ValueError("give at least one grouping column")
    names = names or [f"p{round(p * 100):02d}" for p in probs]
    sums = spread_out(powerlaw_sums(df, by, x, y, pop, grid["beta"]), *by, "i")
    # for given beta and sigma the log posterior is c0 + c1 a - c2 a^2 + ln a
    cells = sums.withColumn("_g", F.explode(_log_grid(*grid["sigma"])))
    g, log_g, s = F.col("_g.v"), F.col("_g.log"), F.col("s")
    twice = g * g * s * s * 2
    cells = cells.select(
        *by, "i", "beta",
        (log_g + F.ln(s) - F.col("j") * (log_g + F.ln(s)) - F.col("syy") / twice - g * g / 32 - F.col("beta") * F.col("beta") / 32).alias("c0"),
        (s * F.col("sxy") * 2 / twice).alias("c1"),
        (s * s * F.col("sxx") / twice + F.lit(1 / 200)).alias("c2"),
    )
    # its largest grid value is next to where the derivative is 0, so the maximum needs no grid over a
    low, high, n = grid["alpha"]
    step = math.log(high / low) / (n - 1)
    peak = (F.col("c1") + F.sqrt(F.col("c1") * F.col("c1") + F.col("c2") * 8)) / (F.col("c2") * 4)
    place = F.floor((F.ln(peak) - math.log(low)) / step)

    def near(k):
        log_a = F.greatest(F.lit(0), F.least(F.lit(n - 1), k)) * F.lit(step) + math.log(low)
        a = F.exp(log_a)
        return F.col("c0") + F.col("c1") * a - F.col("c2") * a * a + log_a

    top = cells.groupBy(*by).agg(F.max(F.greatest(near(place), near(place + 1))).alias("_top"))
    full = cells.join(top, by).withColumn("_a", F.explode(_log_grid(low, high, n)))
    a = F.col("_a.v")
    lp = F.col("c0") + F.col("c1") * a - F.col("c2") * a * a + F.col("_a.log")
    mass = full.groupBy(*by, "i", "beta").agg(F.sum(F.exp(lp - F.col("_top"))).alias("w"))
    # the rest runs on the beta grid: a few hundred rows per group
    along = Window.partitionBy(*by).orderBy("i")
    whole = Window.partitionBy(*by)
    cdf = mass.withColumn("c", F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(whole))
    cdf = cdf.withColumn("c0", F.lag("c", 1, 0.0).over(along)).withColumn("b0", F.lag("beta").over(along))
    aggs = []
    for p, name in zip(probs, names):
        inside = (F.col("c0") < p) & (F.col("c") >= p)
        at = F.coalesce(F.col("b0"), F.col("beta")) + (F.col("beta") - F.coalesce(F.col("b0"), F.col("beta"))) * F.try_divide(
            F.lit(p) - F.col("c0"), F.col("c") - F.col("c0")
        )
        aggs.append(F.pow(F.lit(2.0), F.min(F.when(inside, at))).alias(name))
    return cdf.groupBy(*by).agg(*aggs)
