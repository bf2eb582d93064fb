"""Approximate nearest neighbours over balanced posting lists.

* Equal vectors are one node, with as many of their smallest ids as a result can show.
* Centroids come from balanced k-means on a bounded sample of nodes, the ``SAMPLE`` smallest by a
  hash; crowded clusters become dearer from round to round. Their number grows with the
  nodes up to ``CENTROIDS``; beyond it lists grow and are cut into segments instead.
* Centroids are searched through a graph of their nearest neighbours, best first.
* Every node is put in the list of its nearest centroid. A node at a boundary is replicated to
  other lists nearly as near, unless a list it is in already lies in that direction.
* A query reads the lists whose centroids are at most ``RATIO`` times as far as the nearest one.
  Lists are read in segments of bounded size, each giving its best; the bests are merged.

Distances that are returned are exact: double precision, on the original vectors.

Defined results: vectors that are null, zero, without id, or hold null or non-finite components
take no part, nor do those of another length than most rows have. Repeated rows of one id
count once. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdata.llm.arrow import column, share_code
from regdata.llm.few import smallest
from regdata.session import materialise

SAMPLE, CENTROIDS, LIST = 16_000, 2_000, 200  # LIST: nodes per centroid aimed at
ROUNDS, DEGREE, ENTRIES = 8, 16, 8
SPREAD, REPLICAS, APART = 1.05, 4, 0.5  # how far a further list may be, how many a node is in, how far apart they are
RATIO, LEAST, ENOUGH = 1.15, 24, 400  # LEAST: centroids looked at in any case; ENOUGH: nodes read in any case
SEGMENT, TOGETHER = 2_048, 256  # nodes of a segment, queries that meet it at once


def usable(vectors: Column) -> Column:
    """Whether a vector takes part."""
    sound = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(sound & F.exists(vectors, lambda x: x != 0), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids of clusters of similar size."""
    rng = np.random.Generator(np.random.Philox(key=10))
    centres = points[rng.choice(len(points), k, replace=False)]
    price = np.zeros(k)
    for _ in range(ROUNDS):
        own, near = [], []
        for part in np.array_split(points, max(1, len(points) * k // 2_000_000)):
            d = squared(part, centres)
            own.append((d + price).argmin(axis=1))
            near.append(d.min(axis=1))
        own = np.concatenate(own)
        size = np.bincount(own, minlength=k)
        price += 0.1 * np.concatenate(near).mean() * (size * k / len(points) - 1)
        sums = np.stack([np.bincount(own, points[:, c], k) for c in range(points.shape[1])], axis=1)
        centres = sums[size > 0] / size[size > 0][:, None]
        price, k = price[size > 0], int((size > 0).sum())
    return centres


class Graph:
    """Centroids, each linked to its nearest neighbours and to a few at random."""

    def __init__(self, sample: np.ndarray, centres: np.ndarray):
        self.centres = centres
        self.usual = float(np.median(np.sqrt(squared(sample, centres).min(axis=1))))
        self.sizes = np.zeros(len(centres), dtype=np.int64)  # nodes in each list, once they are counted
        self.apart = np.sqrt(squared(centres, centres)).astype(np.float32)
        k = len(centres)
        rng = np.random.Generator(np.random.Philox(key=11))
        near = self.apart.argsort(axis=1)[:, 1 : DEGREE + 1]
        far = rng.integers(0, k, (k, 4))
        self.links = np.concatenate([near, far], axis=1)
        self.entries = rng.permutation(k)[:ENTRIES]

    def search(self, points: np.ndarray, ratio: float, least: int = LEAST) -> np.ndarray:
        """Distances from each point to the centroids met, infinite for the others.

        The nearest centroid whose neighbours were not looked at yet is next, until it is more
        than ``ratio`` times as far as the nearest of all and ``least`` have been looked at.
        """
        n, k = len(points), len(self.centres)
        met = np.full((n, k), np.inf)
        met[:, self.entries] = np.sqrt(squared(points, self.centres[self.entries]))
        todo = met.copy()
        for step in range(k):
            best = todo.argmin(axis=1)
            value = todo[np.arange(n), best]
            active = np.flatnonzero(np.isfinite(value) & ((value <= ratio * met.min(axis=1)) | (step < least)))
            if not len(active):
                break
            best = best[active]
            linked, at = self.links[best], active[:, None]
            far = np.sqrt(((points[active][:, None, :] - self.centres[linked]) ** 2).sum(axis=2))
            todo[at, linked] = np.where(np.isinf(met[at, linked]), far, todo[at, linked])
            met[at, linked] = far
            todo[active, best] = np.inf
        return met


def replicas(graph: Graph, points: np.ndarray) -> list[list[int]]:
    """Lists that each point is put in; with the centroids in memory all distances are one product."""
    met = np.sqrt(squared(points, graph.centres))
    order = met.argsort(axis=1, kind="stable")[:, : 4 * REPLICAS]
    out = []
    for row, ids in zip(met, order.tolist()):
        chosen: list[int] = []
        for j in ids:
            if row[j] > SPREAD * row[ids[0]] or len(chosen) == REPLICAS:
                break
            if all(graph.apart[i, j] > APART * row[j] for i in chosen):
                chosen.append(j)
        out.append(chosen)
    return out


def probes(graph: Graph, points: np.ndarray) -> list[list[int]]:
    """Lists that each query reads: those near enough, and in any case enough to hold ``ENOUGH`` nodes.

    A query close to a centroid is judged by the usual distance to the nearest centroid.
    """
    met = graph.search(points, RATIO)
    out = []
    for row in met:
        order = row.argsort(kind="stable")
        near = int((row <= RATIO * max(row.min(), graph.usual)).sum())
        held = int(np.searchsorted(np.cumsum(graph.sizes[order]), ENOUGH)) + 1
        out.append(order[: max(near, held)].tolist())
    return out


def matrix(vectors: pa.ListArray) -> np.ndarray:
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)


def with_lists(df: DataFrame, graph: Graph, pick, vector: str) -> DataFrame:
    """One row per row and list that ``pick`` names."""
    share_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                picked = pick(shared.value, matrix(column(part, vector)))
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(p) for p in picked]))
                rows = part.take(at)
                lists = pa.array([x for p in picked for x in p], pa.int32())
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, "_list"])

    return df.mapInArrow(run, df.select("*", F.lit(0).alias("_list")).schema)


def nearest_in_segments(met: DataFrame, top: int) -> DataFrame:
    """Best ``top`` nodes of a segment for each query that meets it: ``_q``, ``_node``, ``_score``."""
    share_code(met.sparkSession)

    def run(batches):
        for batch in batches:
            for asked, held in zip(column(batch, "_asked"), column(batch, "_held")):
                asked, held = asked.values, held.values
                nodes, points = held.field(0).to_numpy(), matrix(held.field(1))
                heads, wanted = asked.field(0).to_numpy(), matrix(asked.field(1))
                rough = squared(wanted, points)
                last = np.partition(rough, min(top, len(nodes)) - 1, axis=1)[:, min(top, len(nodes)) - 1]
                # all that may be among the best, whatever the rounding of the product
                q, at = np.nonzero(rough <= (last + 1e-9 * (1 + (wanted * wanted).sum(axis=1)))[:, None])
                score = np.sqrt(((points[at] - wanted[q]) ** 2).sum(axis=1))
                order = np.lexsort((nodes[at], score, q))
                q, at, score = q[order], at[order], score[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < top
                yield pa.RecordBatch.from_arrays([pa.array(heads[q[keep]]), pa.array(nodes[at[keep]]), pa.array(score[keep])], ["_q", "_node", "_score"])

    return met.mapInArrow(run, "_q long, _node long, _score double")


def search(table: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest others of every row that ``queries`` marks: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    rows = table.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(queries, F.lit(False)).alias("_ask")
    )
    lengths = rows.groupBy(F.size("_v").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    usual = lengths.agg(F.max_by("_d", F.struct("_n", -F.col("_d")))).scalar()
    rows = rows.where(F.size("_v") == usual)
    rank = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    first = rows.select("_id", "_v").distinct().withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    nodes = materialise(first.groupBy("_v").agg(F.min("_id").alias("_node"), F.sort_array(F.collect_list("_id")).alias("_ids")))
    asked = rows.where("_ask").select("_id", "_v").distinct().join(nodes.select("_v", F.col("_node").alias("_q")), "_v")
    asked = materialise(asked.select(F.col("_id").alias("query_id"), "_q"))

    n = nodes.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return table.sparkSession.createDataFrame([], schema)
    drawn = nodes.select("_node", "_v", F.xxhash64("_node").alias("_order"))
    picked = smallest(drawn, "_order", ["_node"], SAMPLE).toPandas()  # at most SAMPLE vectors
    sample = np.array(picked["_v"].tolist(), dtype=np.float64)
    graph = Graph(sample, balanced(sample, max(1, min(CENTROIDS, len(sample), n // LIST))))

    posted = materialise(with_lists(nodes.select("_node", "_v"), graph, replicas, "_v"))
    sizes = materialise(posted.groupBy("_list").agg(F.count(F.lit(1)).alias("_members")))
    for row in sizes.collect():  # one per centroid, at most CENTROIDS
        graph.sizes[row["_list"]] = row["_members"]
    sizes = sizes.select("_list", F.ceil(F.col("_members") / SEGMENT).alias("_segments"))
    cut = posted.join(sizes, "_list").withColumn("_segment", F.pmod(F.xxhash64("_node"), "_segments"))
    held = cut.groupBy("_list", "_segment").agg(F.collect_list(F.struct("_node", "_v")).alias("_held"))
    heads = nodes.join(asked.select(F.col("_q").alias("_node")).distinct(), "_node", "left_semi").select(F.col("_node").alias("_q"), "_v")
    wanted = with_lists(heads, graph, probes, "_v").join(sizes, "_list")
    counts = wanted.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_blocks"))
    wanted = wanted.join(counts, "_list").withColumn("_block", F.pmod(F.xxhash64("_q"), "_blocks"))
    groups = wanted.groupBy("_list", "_segments", "_block").agg(F.collect_list(F.struct("_q", "_v")).alias("_asked"))
    groups = groups.withColumn("_segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_segments") - 1))).drop("_segments", "_block")
    found = nearest_in_segments(groups.join(held, ["_list", "_segment"]), k + 1)
    best = found.groupBy("_q", "_node").agg(F.min("_score").alias("_score"))
    best = best.withColumn("_rank", F.row_number().over(Window.partitionBy("_q").orderBy("_score", "_node"))).where(F.col("_rank") <= k + 1)
    each = best.join(nodes.select("_node", "_ids"), "_node").select("_q", "_score", F.explode("_ids").alias("vec_id"))
    each = each.withColumn("_rank", F.row_number().over(Window.partitionBy("_q").orderBy("_score", "vec_id"))).where(F.col("_rank") <= k + 1)
    lists = each.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("_score", "vec_id"))).alias("_best"))
    told = asked.join(lists, "_q").select("query_id", F.slice(F.filter("_best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("_best"))
    ranked = told.select("query_id", F.posexplode("_best").alias("_at", "_one"))
    return ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_one.vec_id").alias("vec_id"), F.col("_one._score").alias("score"))
