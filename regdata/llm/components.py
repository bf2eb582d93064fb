"""Connected components of an edge table: in one task while it is small, else in rounds of joins on narrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdata.llm.few import is_small
from regdata.session import materialise, share_code

FEW = 500_000  # edges of 16 bytes that one task may hold


def within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of edges and the smallest of their component."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        # what an edge learns, its ends and the labels they had so far learn too
        for to in (left, right, label[left], label[right]):
            np.minimum.at(new, to, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``c``, the smallest id reachable, for every end of the edges ``a``, ``b``.

    The edges are read twice or more: hand over a materialised table. At most ``FEW`` of them meet in one task, and the
    answer is marked for broadcast. Beyond that, in each round a component takes the smallest label among
    its neighbours' (every member learns what any member found), then labels jump to the labels of
    their labels, so the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select("a", "b")
    if is_small(edges, FEW):
        share_code(edges.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in within(a, b)], ["id", "c"])

        return F.broadcast(materialise(edges.repartition(1).mapInArrow(run, "id long, c long")))
    both = materialise(edges.union(edges.select("b", "a")).distinct())
    state = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        seen = both.join(state, both.a == state.id).groupBy(F.col("b").alias("id")).agg(F.min("c").alias("m"))
        found = state.join(seen, "id").select("id", "c", F.least("c", "m").alias("m"))
        root = found.groupBy(F.col("c").alias("r")).agg(F.min("m").alias("to"))
        moved = found.join(root, found.c == root.r).select("id", F.col("c").alias("old"), F.col("to").alias("c"))
        jump = root.select(F.col("r").alias("c"), F.col("to").alias("next"))
        new = materialise(moved.join(jump, "c", "left").select("id", F.coalesce("next", "c").alias("c"), "old"))
        state = new.select("id", "c")
        if not new.where("c <> old").limit(1).count():
            return state
