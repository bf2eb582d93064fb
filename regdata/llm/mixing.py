"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Among all document rates w between 0 and ``CAP``
whose words add up to the targets, entropy balancing takes those closest to 1 in relative
entropy: w = min(CAP, exp(m * size)), one multiplier m per source, scaled by the source's mean
size. The multipliers solve the convex dual, one equation per source. Documents are first
aggregated to (source, size, count) rows, which hold all there is to know about them; then
Newton's method finds each source's multiplier on log(words), where its rows are. These are its
distinct sizes: d of them need d * d / 2 words, so they grow at most with the square root of the
source. A step that leaves the bracket known so far is replaced by its middle.

Rates are rounded into copies in two parts. Per source, sizes are walked from large to small,
and each takes the whole number of copies that brings the words taken so far closest to the
words due, so what is left at the end is at most half of a small document. Within a size,
documents get equal copies and the first by a hash get one more; they are ranked inside pieces of
bounded size. Reruns agree, as nothing depends on the order of rows.

Targets: weights repeat over the sources in order of code points, null last. A source's share of
all words follows its weight, up to ``CAP`` times its own words; what that leaves over is shared
out again by weight among the others.

Defined results: a null text has size 0 and takes nothing. A source without words has target
0. Rows of equal id and text get equal copies. Where the rates of a source are all the cap or 0
the dual has no finite solution, and they are taken as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdata.llm.arrow import parcel, without
from regdata.llm.few import is_small
from regdata.session import materialise

CAP = 3
WEIGHTS = (5, 2, 1)
PIECE = 256  # documents of one source and size that are ranked together
CELLS = 200_000  # (source, size) rows that may be broadcast; more are joined by a shuffle
ROUNDS, CLOSE = 60, 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``_source``, ``_words`` and ``_target`` from rows of ``_source``, ``_size``, ``_n``.

    One row per source is ranked and shared out; capped sources leave in rounds, each of
    which caps all sources above their limit at once and is one row of sums.
    """
    sums = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_words"), F.sum("_n").alias("_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    state = materialise(sums.withColumn("_weight", weight))
    limit = F.col("_words") * F.lit(float(cap))
    full, known = F.lit(False), -1
    while True:
        told = state.agg(
            F.sum("_words").alias("words"), F.sum(F.when(full, F.col("_words"))).alias("capped"), F.sum(F.when(~full, F.col("_weight"))).alias("open"),
            F.count_if(full).alias("full"),
        ).first()
        if told["full"] <= known:
            return state.select("_source", "_words", "_docs", "_weight", target.alias("_target"))
        left = (told["words"] or 0) - (told["capped"] or 0) * cap
        share = F.lit(left).cast("long") * F.col("_weight") / F.lit(told["open"]).cast("double")
        target = F.when(full, limit).otherwise(share).cast("double")
        full, known = full | F.coalesce(share > limit, F.lit(True)), told["full"]


def _solve(cap: int):
    """Newton's method for one source: ``_m`` from its sizes, counts, target and mean size."""
    top = math.log(cap)

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_size")  # sums do not depend on the order of arrival
        size, n = own["_size"].to_numpy(float), own["_n"].to_numpy(float)
        goal, z = math.log(own["_target"].iloc[0]), size / own["_mean"].iloc[0]
        m, low, high = 0.0, None, None
        for _ in range(ROUNDS):
            mass = n * size * np.exp(np.minimum(m * z, top))
            got, slope = mass.sum(), (mass * z)[m * z < top].sum()
            gap = math.log(got) - goal if got else -math.inf
            if abs(gap) < CLOSE:
                break
            low, high = (m, high) if gap < 0 else (low, m)
            step = m - gap * got / slope if slope else math.nan
            if (low is None or step > low) and (high is None or step < high) and abs(step - m) < 50:
                m = step
            elif low is None:
                m = high - 2 * (1 + abs(high))
            else:
                m = low + 2 * (1 + abs(low)) if high is None else (low + high) / 2
        return own[["_source"]].head(1).assign(_m=m)

    return solve


def rates(sizes: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """``_source`` and ``_m``, the multiplier of its sizes; null where every rate is the cap."""
    goals = goals.where("_words > 0").withColumn("_mean", F.col("_words") / F.col("_docs"))
    # at the cap the dual has no finite solution: all rates are the cap itself
    free = goals.where(F.col("_target") < F.col("_words") * (cap - 1e-12)).where("_target > 0").select(F.col("_source").alias("_s"), "_target", "_mean")
    own = sizes.where("_size > 0").join(free, F.col("_source").eqNullSafe(F.col("_s"))).select("_source", "_size", "_n", "_target", "_mean")
    found = own.groupBy("_source").applyInPandas(_solve(cap), "_source string, _m double").withColumnRenamed("_source", "_s")
    return goals.select("_source", "_words", "_target", "_mean").join(found, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _walk(cap: int):
    def walk(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("_size", ascending=False)
        due = taken = 0.0
        out = []
        for size, n, rate in zip(sizes["_size"].tolist(), sizes["_n"].tolist(), sizes["_rate"].tolist()):
            due += size * n * rate
            copies = min(cap * n, max(0, round((due - taken) / size)))
            taken += copies * size
            out.append(copies)
        return sizes.assign(_copies=out)[["_source", "_size", "_n", "_copies"]]

    return walk


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``_s``, ``_z``, ``_last``: the hash up to which documents of a source and size get one more copy.

    Hashes are cut into pieces of about ``PIECE`` documents in hash order. The ranks inside
    a piece and the documents in the pieces before it add up to the rank in the whole.
    """
    some = plan.where("_copies % _n > 0").select("_s", "_z", "_n", (F.col("_copies") % F.col("_n")).alias("_more"))
    held = rows.join(some, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    part = F.least(F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("_n") / PIECE)), F.ceil(F.col("_n") / PIECE) - 1)
    held = held.select("_s", "_z", "_more", "_h", part.alias("_piece"))
    cell = [F.coalesce(F.xxhash64("_s"), F.lit(0)).alias("_g"), F.col("_s").isNull().alias("_none")]
    held = held.select("*", *cell)
    keys = ["_g", "_none", "_z", "_piece"]
    counts = held.groupBy("_s", "_more", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy("_g", "_none", "_z").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_rows").over(upto))
    here = counts.where("_upto >= _more and _upto - _rows < _more").select(*keys, (F.col("_more") - F.col("_upto") + F.col("_rows")).alias("_at"))
    ranked = held.join(here, keys).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_h")))
    return ranked.where("_rank = _at").select("_s", "_z", F.col("_h").alias("_last"))


def planned(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Copies of every source and size (``_s``, ``_z``): ``_each`` for all, one more up to hash ``_last``."""
    cells = materialise(sized.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n")))
    goals = materialise(targets(cells, weights, cap))
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("_m") * F.col("_size") / F.col("_mean"), F.lit(5.0))))
    at_edge = F.when(F.col("_target") > 0, F.lit(float(cap))).otherwise(0.0)
    found = rates(cells, goals, cap).withColumnRenamed("_source", "_s")
    rated = cells.where("_size > 0").join(found, F.col("_source").eqNullSafe(F.col("_s")))
    rated = rated.select("_source", "_size", "_n", F.coalesce(tilted, at_edge).alias("_rate"))
    # a source's rows here are its distinct sizes, at most as many as its longest text has words
    schema = "_source string, _size bigint, _n bigint, _copies bigint"
    copies = rated.groupBy("_source").applyInPandas(_walk(cap), schema).select(F.col("_source").alias("_a"), F.col("_size").alias("_b"), "_copies")
    plan = cells.join(copies, F.col("_source").eqNullSafe(F.col("_a")) & (F.col("_size") == F.col("_b")), "left").drop("_a", "_b")
    goal = goals.select(F.col("_source").alias("_a"), F.col("_words").alias("source_size"), F.col("_target").alias("target"))
    plan = plan.join(goal, F.col("_source").eqNullSafe(F.col("_a")))
    plan = materialise(plan.select(
        F.col("_source").alias("_s"), F.col("_size").alias("_z"), "_n", F.coalesce("_copies", F.lit(0)).alias("_copies"), "source_size", "target"
    ))
    last = thresholds(sized.select("_source", "_size", "_h"), plan).withColumnRenamed("_s", "_a").withColumnRenamed("_z", "_b")
    plan = plan.join(last, F.col("_s").eqNullSafe(F.col("_a")) & (F.col("_z") == F.col("_b")), "left")
    return materialise(plan.select("_s", "_z", "source_size", "target", F.floor(F.col("_copies") / F.col("_n")).alias("_each"), "_last"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words of all copies)."""
    docs = without(docs, "size", "source_size", "target", "copies", "taken")
    rows, columns = parcel(docs, _key=key, _t=text)
    named = F.col("_row").getField(source)
    sized = rows.withColumns({"_source": named.cast("string"), "_size": word_count(F.col("_t")), "_h": F.xxhash64("_key", "_t")})
    plan = planned(sized.select("_source", "_size", "_h"), weights, cap)
    plan = F.broadcast(plan) if is_small(plan, CELLS) else plan
    joined = sized.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    copies = F.col("_each") + F.when(F.col("_h") <= F.col("_last"), 1).otherwise(0)
    return joined.select(
        *columns, F.col("_size").alias("size"), "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"),
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    rows, columns = parcel(docs, doc_id=options.get("key", "doc_id"), text=options.get("text", "text"), source=options.get("source", "source"))
    docs, options = rows, {k: v for k, v in options.items() if k not in ("key", "text", "source")}
    taken = mix(docs, **options).where("copies > 0")
    return taken.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)
