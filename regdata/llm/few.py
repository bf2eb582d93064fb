"""Joins of a wide table with marks on some of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 2_000  # keys with more than this part of all rows are split
SMALL = 500_000  # keys of 16 bytes that may be broadcast; with more, all rows are shuffled


def is_small(keys: DataFrame, limit: int = SMALL) -> bool:
    """Whether a table has at most ``limit`` rows, by counting no further than that."""
    return keys.limit(limit + 1).count() <= limit


def only_marked(wide: DataFrame, marks: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``wide`` with a mark, joined with it; unmarked rows don't move while the keys are few."""
    keys = marks.select(*on).distinct()
    if is_small(keys):
        wide = wide.join(F.broadcast(keys), on, "left_semi")
    return wide.join(marks, on)


def with_marks(wide: DataFrame, marks: DataFrame, on: list[str]) -> DataFrame:
    """Left join with unique marks; unmarked rows don't move while the keys are few."""
    keys = marks.select(*on)
    if not is_small(keys):
        return wide.join(marks, on, "left")
    plain = wide.join(F.broadcast(keys), on, "left_anti")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema if f.name not in on]
    plain = plain.select(*[F.col(f"`{c}`") for c in wide.columns], *empty)
    return wide.join(F.broadcast(keys), on, "left_semi").join(marks, on).select(*plain.columns).unionByName(plain)


def smallest(df: DataFrame, order: str, ties: list[str], n: int) -> DataFrame:
    """The n rows with the smallest ``order``, a 64-bit hash; ties by other columns.

    Rows are counted first and thinned to about 2n by a threshold on the hash, so what tasks hand on
    does not grow with the table. Should fewer than n pass, which many rows with one hash can
    bring about, all rows are sorted.
    """
    share = min(1.0, (2 * n + 200) / max(1, df.count()))
    low, span = -(2**63), 2**64
    near = df.where(F.col(order) <= F.lit(min(2**63 - 1, low + int(share * span)))) if share < 1 else df
    if share < 1 and is_small(near, n - 1):
        near = df
    return near.orderBy(order, *ties).limit(n)


def join_spread(rows: DataFrame, owners: DataFrame, on: str, size: str, by: list[str]) -> DataFrame:
    """Join rows with the one owner of their key; ``size`` is how many rows a key has.

    Keys above a two-thousandth of all rows, fewer than 2,000 whatever the size of the table, are dealt to
    several tasks by a hash of ``by``, as many as it takes to be no larger than the others.
    """
    limit = max(1_000, (owners.agg(F.sum(size)).first()[0] or 0) // HOT)
    parts = owners.withColumn("_parts", F.ceil(F.col(size) / limit).cast("int")).drop(size)
    hot = parts.where("_parts > 1").select(on, "_parts")
    dealt = rows.join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    copied = parts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copied, [on, "_part"]).drop("_part")
