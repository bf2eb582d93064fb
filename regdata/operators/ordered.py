"""Running values over groups of any size.

A window over a whole group puts the group into one task. These operators instead
work on ordered *pieces* of a group: a window inside each piece, one row of totals per
piece, and a join that adds what came before the piece. ``pieces`` are columns that are
a prefix of the wanted order, ``order`` the rest of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdata.session import materialise


def _join_pieces(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on piece keys, missing keys matching each other."""
    renamed = totals.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(renamed, cond, "left").drop(*[f"_k_{k}" for k in keys])


def prefix_sums(df: DataFrame, by: list[str], pieces: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Running sums (``{out: column}``) along each group, this row included."""
    inside = Window.partitionBy(*by, *pieces).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, *pieces).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    totals = totals.select(
        *by, *pieces,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
    )
    out = df.withColumns({o: F.sum(c).over(inside) for o, c in sums.items()})
    out = _join_pieces(out, totals, [*by, *pieces])
    return out.withColumns({o: F.col(o) + F.col(f"_b_{o}") for o in sums}).drop(*[f"_b_{o}" for o in sums])


def row_numbers(df: DataFrame, by: list[str], pieces: list[str], order: list, name: str = "rn") -> DataFrame:
    """1-based position of each row in its group, ordered by ``pieces`` then ``order``."""
    return prefix_sums(df.withColumn("_one", F.lit(1)), by, pieces, order, {name: "_one"}).drop("_one")


def fill_forward(df: DataFrame, by: list[str], pieces: list[str], order: list, cols: list[str]) -> DataFrame:
    """Replace nulls by the last value before them in the group."""
    inside = Window.partitionBy(*by, *pieces).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    sort_key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    last_of_piece = df.groupBy(*by, *pieces).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), sort_key)).alias(f"_l_{c}") for c in cols]
    )
    carried = last_of_piece.select(
        *by, *pieces, *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_b_{c}") for c in cols]
    )
    out = df.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in cols})
    out = _join_pieces(out, carried, [*by, *pieces])
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_b_{c}")) for c in cols}).drop(*[f"_b_{c}" for c in cols])


def positions(df: DataFrame, by: list[str], order: list, name: str = "rn") -> DataFrame:
    """0-based position of each row in its group, by ``order``, whatever the size of a group.

    Rows are dealt to tasks by ranges of (group, order) and sorted there, so a hot group is spread
    in proportion to its rows. A row's position is its place in its range, less that of the group's
    first row there, plus what the group has in earlier ranges: one count per group and
    range. ``order`` should tell rows apart; equal ones share a task and come in any order.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in (*by, *order)]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    # later ranges must not be drawn anew with other bounds
    ranged = materialise(ranged.withColumn("_part", F.shiftright("_at", 33)))
    parts = ranged.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(*by, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return _join_pieces(ranged, shifts, [*by, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def piece_count(df: DataFrame) -> int:
    """Pieces to cut a column into: twice the shuffle partitions, within 64 and 4096."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(4096, max(64, 2 * partitions))


def value_pieces(df: DataFrame, col: str, n: int | None = None) -> list[float]:
    """Edges that cut a numeric column into about ``n`` equal pieces.

    They are read from an approximate quantile summary, so at most ``n`` numbers reach the
    driver. Results do not depend on where the edges fall, only the balance does; but
    every use within a query must see the same ones, hence plain numbers.
    """
    n = n or piece_count(df)
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, max(10_000, 4 * n)).alias("edges")).first()
    return sorted(set(row.edges or []))


def count_below(x: Column, edges: list[float]) -> Column:
    """How many of the sorted edges are smaller than ``x``, by binary search."""
    bits = len(edges).bit_length()
    padded = F.array(*[F.lit(float(e)) for e in edges], *[F.lit(float("inf"))] * (2**bits - 1 - len(edges)))
    steps = F.array(*[F.lit(2**b) for b in reversed(range(bits))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(padded[at + step - 1] < x, step).otherwise(0)
    )


def with_value_piece(df: DataFrame, col: str, edges: list[float], name: str = "_piece") -> DataFrame:
    """Piece number of each value. A value that is an edge gets a piece of its own, so a
    value shared by many rows never drags its neighbours along."""
    if not edges:
        return df.withColumn(name, F.lit(0))
    x = F.col(col).cast("double")
    out = df.withColumn("_below", count_below(x, edges))
    exact = F.coalesce(F.try_element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("_below") + 1) == x, F.lit(False))
    return out.withColumn(name, F.col("_below") * 2 + exact.cast("int")).drop("_below")
