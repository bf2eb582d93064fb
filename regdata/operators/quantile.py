"""Exact quantiles, quantile bins and histograms without gathering a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdata.functions.nulls import known_keys
from regdata.operators.ordered import value_pieces, with_value_piece

STEPS, PARTS = 4096, 1 << 16  # buckets of the histograms that select a rank


def value_ranks(df: DataFrame, by: list[str], col: str, pieces: int | None = None) -> DataFrame:
    """Distinct values of each group with the half-open range of ranks they take.

    Columns: ``by``, ``value``, ``start``, ``end`` (0-based, ``end`` excluded), ``n``. Rows
    are first counted per (group, value), so copies collapse before any shuffle of
    size; ranks come from sums inside value pieces plus the totals of earlier pieces.
    """
    x = F.col(col).cast("double")
    present = known_keys(df, *by).select(*by, x.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    edges = value_pieces(present, "value", pieces)
    counted = present.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_c"))
    counted = with_value_piece(counted, "value", edges)
    inside = Window.partitionBy(*by, "_piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # straight from the rows: what crosses the network is one number per task, group and piece
    totals = with_value_piece(present, "value", edges).groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_t"))
    totals = totals.select(
        *by, "_piece",
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"),
        F.sum("_t").over(Window.partitionBy(*by)).alias("n"),
    )
    ranked = counted.withColumn("_in", F.sum("_c").over(inside)).join(totals, [*by, "_piece"])
    return ranked.select(
        *by, "value",
        (F.col("_before") + F.col("_in") - F.col("_c")).alias("start"),
        (F.col("_before") + F.col("_in")).alias("end"),
        "n",
    )


def _log_bucket(x: Column) -> Column:
    """A whole number that does not fall as x grows: ``STEPS`` to a factor of e, and to 1 around zero."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * STEPS)


def _span_bucket(x: Column, low: Column, high: Column) -> Column:
    """Part of [low, high] that x lies in, of ``PARTS``; halves keep the width of any two numbers finite."""
    return F.floor(F.coalesce(F.try_divide(x / 2 - low / 2, high / 2 - low / 2), F.lit(0.0)) * PARTS)


def _ranges(counts: DataFrame, within: list[str], order: str) -> DataFrame:
    """Add the half-open range of ranks, ``start`` to ``end``, of each row of counts ``_c``."""
    upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("end", F.sum("_c").over(upto)).withColumn("start", F.col("end") - F.col("_c"))


def selected(df: DataFrame, by: list[str], col: str, probs: list[float]) -> DataFrame:
    """Columns ``by``, ``n``, and ``low``, ``high``: for each probability the values at the ranks around its place.

    A selection by histograms, not a sort. The first counts values on a logarithmic scale; the bucket that
    holds a wanted rank is counted again in ``PARTS`` equal parts between its smallest and its
    largest value; and only values of the parts so found, a few in a hundred million of
    the range, are told apart. What is shuffled is a count per task and bucket. Each pass reads
    the input again, so it should be a table or cheap.
    """
    x = F.col(col).cast("double")
    rows = known_keys(df, *by).select(*by, x.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", _log_bucket(F.col("_v")))
    bounds = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    places = [(p, f) for p in probs for f in (F.floor, F.ceil)]

    def wanted(ranges: DataFrame, found: Column, marks: list[Column]) -> DataFrame:
        inside = [m & (F.col("start") <= F.get("_want", i)) & (F.get("_want", i) < F.col("end")) for i, m in enumerate(marks)]
        return ranges.groupBy(*by).agg(
            F.first("_n").alias("_n"),
            F.array(*[F.max(F.when(m, F.get("_want", F.lit(i)) - F.col("start"))) for i, m in enumerate(inside)]).alias("_left"),
            F.array(*[F.max(F.when(m, found)) for m in inside]).alias("_hit"),
        )

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        if by:
            return left.join(right, by)
        one = right.select(F.struct(*right.columns).alias("_one")).scalar()  # without groups the right side is one row
        return left.withColumn("_one", one).select(*left.columns, "_one.*")

    first = _ranges(rows.groupBy(*by, "_b").agg(*bounds), by, "_b").withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    first = first.withColumn("_want", F.array(*[f((F.col("_n") - 1) * F.lit(float(p))).cast("long") for p, f in places]))
    told = wanted(first, F.struct("_b", "_min", "_max"), [F.lit(True)] * len(places))
    told = told.withColumn("_in", F.map_from_entries(F.array_distinct(F.transform("_hit", lambda h: F.struct(h["_b"], h)))))

    near = beside(rows, told.select(*by, "_in")).withColumn("_span", F.try_element_at("_in", "_b")).where("_span is not null")
    near = near.withColumn("_d", _span_bucket(F.col("_v"), F.col("_span._min"), F.col("_span._max"))).select(*by, "_b", "_d", "_v")
    second = beside(
        _ranges(near.groupBy(*by, "_b", "_d").agg(F.count(F.lit(1)).alias("_c")), [*by, "_b"], "_d"),
        told.select(*by, "_n", F.col("_left").alias("_want"), F.col("_hit").alias("_of")),
    )
    told = wanted(second, F.struct("_b", "_d"), [F.col("_b") == F.get("_of", F.lit(i))["_b"] for i in range(len(places))])

    last = beside(near, told.select(*by, F.array_distinct("_hit").alias("_in"))).where(F.array_contains("_in", F.struct("_b", "_d")))
    third = beside(
        _ranges(last.groupBy(*by, "_b", "_d", "_v").agg(F.count(F.lit(1)).alias("_c")), [*by, "_b", "_d"], "_v"),
        told.select(*by, "_n", F.col("_left").alias("_want"), F.col("_hit").alias("_of")),
    )
    told = wanted(third, F.col("_v"), [F.struct("_b", "_d") == F.get("_of", F.lit(i)) for i in range(len(places))])
    return told.select(*by, F.col("_n").alias("n"), *[F.array(*[F.get("_hit", F.lit(i)) for i in range(k, len(places), 2)]).alias(c) for k, c in enumerate(("low", "high"))])


def quantiles(
    df: DataFrame, by: list[str], col: str, probs: list[float], names: list[str] | None = None,
    method: str = "ranked",
) -> DataFrame:
    """Linear-interpolation quantiles per group, nulls ignored.

    ``ranked`` is exact, whatever the size of a group; ``builtin`` is exact and meant for groups
    known to be small (it holds a group's distinct values in one buffer); ``approx`` is
    a bounded-memory estimate without interpolation.
    """
    names = names or [f"q{round(p * 100):02d}" for p in probs]
    if method != "ranked":
        src = known_keys(df, *by).where(~F.isnan(F.col(col).cast("double")))
        if method == "builtin":
            aggs = [F.percentile(col, F.lit(p)).alias(n) for p, n in zip(probs, names)]
        else:
            aggs = [F.percentile_approx(col, p, 10000).cast("double").alias(n) for p, n in zip(probs, names)]
        return src.groupBy(*by).agg(*aggs)
    found = selected(df, by, col, probs)
    outs = []
    for i, (p, name) in enumerate(zip(probs, names)):
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.get("low", F.lit(i)), F.get("high", F.lit(i))
        outs.append((low + (high - low) * (place - F.floor(place))).alias(name))
    # without groups there is one row, of nulls where there are no values
    return found.select(*by, *outs) if by else found.groupBy().agg(F.first(F.struct(*outs)).alias("_q")).select(*[F.col(f"_q.{n}").alias(n) for n in names])


def quantile_edges(df: DataFrame, col: str, n: int, distinct: bool = False) -> Column:
    """``n + 1`` quantile edges of a column as a scalar subquery (one small array)."""
    names = [f"e{i}" for i in range(n + 1)]
    row = quantiles(df, [], col, [i / n for i in range(n + 1)], names)
    edges = F.array(*names)
    return row.select((F.array_distinct(edges) if distinct else edges).alias("edges")).scalar()


def with_bin(
    df: DataFrame, col: str, edges: Column, name: str = "bin", include_lowest: bool = False, centre: str | None = None
) -> DataFrame:
    """0-based bin of half-open ``(a, b]`` intervals, null outside.

    The smallest value lies on the open side of the first bin, so it gets no bin unless
    ``include_lowest``.
    """
    out = df.withColumn("_edges", edges)
    below = F.size(F.filter("_edges", lambda e: e < F.col(col)))
    index = below - 1
    if include_lowest:
        index = F.when(F.col(col) == F.col("_edges")[0], 0).otherwise(index)
    inside = F.col(col).isNotNull() & (index >= 0) & (index < F.size("_edges") - 1)
    out = out.withColumn(name, F.when(inside, index).cast("int"))
    if centre:
        low = F.try_element_at(F.col("_edges"), F.col(name) + 1)
        high = F.try_element_at(F.col("_edges"), F.col(name) + 2)
        out = out.withColumn(centre, (low + high) / 2)
    return out.drop("_edges")


def quantile_bin(df: DataFrame, col: str, n: int, name: str = "bin", include_lowest: bool = False,
                 distinct: bool = False, centre: str | None = None) -> DataFrame:
    """Bin by the column's own quantiles."""
    return with_bin(df, col, quantile_edges(df, col, n, distinct), name, include_lowest, centre)


def histogram(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Counts on fixed edges, every bin ``[a, b)`` but the last one closed; empty bins stay.

    Columns: ``bin``, ``low``, ``high``, ``n``.
    """
    x = F.col(col)
    index = F.lit(-1)
    for e in edges:
        index = index + (x >= F.lit(float(e))).cast("int")
    last = len(edges) - 2
    index = F.when(x == F.lit(float(edges[-1])), last).otherwise(index)
    counts = (
        df.where(x.isNotNull() & x.between(float(edges[0]), float(edges[-1])))
        .groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double"
    )
    return spine.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def doubling_edges(first: float = 200.0, count: int = 19) -> list[float]:
    """``first * 2**k`` to one significant digit."""
    out = []
    for k in range(count):
        value = first * 2**k
        scale = 10 ** math.floor(math.log10(value))
        out.append(float(round(value / scale) * scale))
    return out
