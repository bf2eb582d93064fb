"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.002  # a key with more than this share of the rows is split
SALTS = 64


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: at most 1/share of them."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("_rows") > total * F.lit(share)).select(*on)


def planned_small(df: DataFrame) -> bool:
    """Whether Spark's own size estimate is below its broadcast limit."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().rstrip("b")
    unit = {"k": 2**10, "m": 2**20, "g": 2**30}.get(text[-1:], 1)
    limit = int(text.rstrip("kmg")) * unit
    if not hasattr(df, "_jdf"):  # a remote session does not expose plan statistics
        return False
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join (inner or left) whose hot left keys are spread over ``salts`` tasks.

    Left rows of a hot key get a salt from their own content; the matching right rows
    are repeated once per salt. The table of hot keys has at most ``1 / HOT_SHARE``
    rows whatever the data size, which makes it safe to broadcast. A right side that
    Spark plans to broadcast needs none of this: no left row moves then.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if planned_small(right):
        return left.join(right, on, how)
    hot = F.broadcast(hot_keys(left, on).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    unmatched = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])  # rows without a key go anywhere
    split = F.coalesce(F.col("_hot"), F.lit(False)) | unmatched
    left_s = left.join(hot, on, "left").withColumn("_salt", F.when(split, spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right_s = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left_s.join(right_s, [*on, "_salt"], how).drop("_salt")


def spread_out(df: DataFrame, *cols: str) -> DataFrame:
    """Give a table that is about to be multiplied at least one partition per core.

    Adaptive execution merges partitions by their size on disk, so a few thousand rows
    end up in one task, which then expands them all. A repartition to a fixed number is
    left alone. It is never below the session's shuffle partitions, which are set to the
    size of the data.
    """
    session = df.sparkSession
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(2, partitions, session.sparkContext.defaultParallelism), *cols)
