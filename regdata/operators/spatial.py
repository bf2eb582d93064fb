"""Spatial joins.

*Containment and distance* are equi-joins on cells. A polygon is covered by a bounded number of
cells of mixed size, down from the few that its (widened) box touches: cells that its outline
comes near are cut into sixteen, ``ROUNDS`` times, cells outside go, and cells inside stay as they are. A place in
an inner cell is inside without a look at the outline; only places in cells along the outline
are tested exactly. The size of cells follows each polygon, so a huge one has as many as a small one.

*The nearest polygon* is searched in packed trees of boxes, from the root down, for many places at once: a
box bounds the distance from below and from above, and what is farther than the least upper bound goes.
Distances are compared rounded, as those to a corner that polygons share differ in their last bits.

All of this is done once per distinct place and the answer is joined back to the points:
a default coordinate on a third of the rows is a single place. Cells and outlines are broadcast
while they are few, by count; beyond that crowded cells and polygons are split by :func:`skew_join`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.functions import geo
from regdata.operators.skew import skew_join, spread_out
from regdata.session import materialise, share_code
from regdata.vocab import METERS_PER_MILE, UNKNOWN_PLACE

CELL = ["_lv", "_cx", "_cy"]
ROUNDS = 2  # times that cells along an outline are cut
FEW_CELLS, FEW_SEGMENTS = 200_000, 200_000  # of about 60 and 32 bytes, that may be broadcast
FAN = 16  # boxes under a box of the tree
PAIRS = 1 << 20  # of places and boxes or segments that a task works on at once
TIE_DIGITS = 9  # decimals to which distances must agree to be a tie


def prepare_polygons(polys: DataFrame, rings: str = "rings") -> DataFrame:
    """Replace ``rings`` by ``segs`` and the bounding box ``box``.

    The result is written once: every join below reads it several times, and an outline
    that is computed (projected, say) must not be computed again for each use.
    """
    out = materialise(polys.withColumn("segs", geo.flat_segments(rings)).drop(rings))
    return out.withColumn("box", geo.bounds("segs"))


def _side(level: Column) -> Column:
    """Side of the cells of a level: a power of four, exact in a double."""
    return F.pow(F.lit(4.0), level)


def _toucher(x: Column, y: Column, side: Column, reach: float):
    """Test whether a segment may come within ``reach`` of a cell: it does not if a straight line parts them for sure."""
    slack = side * 1e-9 + reach + F.greatest(F.abs(x), F.abs(y)) * 1e-12
    cx, cy, half = x + side / 2, y + side / 2, side / 2 + slack
    apart = lambda a, b, c: F.least(a, b) > c + half

    def touches(seg: Column) -> Column:
        box = apart(seg["x1"], seg["x2"], cx) | (F.greatest(seg["x1"], seg["x2"]) < cx - half) | apart(seg["y1"], seg["y2"], cy) | (F.greatest(seg["y1"], seg["y2"]) < cy - half)
        dx, dy = seg["x2"] - seg["x1"], seg["y2"] - seg["y1"]
        across = F.abs((cx - seg["x1"]) * dy - (cy - seg["y1"]) * dx)  # distance of the centre from the line, times its length
        return ~(box | (across > half * (F.abs(dx) + F.abs(dy)) * (1 + 1e-9)))

    return touches


def covering(polys: DataFrame, reach: float = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """Cells within ``reach`` of each polygon: ``_name``, ``_lv``, ``_cx``, ``_cy`` and ``_inner``, whether all of the cell is inside.

    At first a polygon has at most four cells, then at most 16 times as many with each round.
    """
    wide = F.greatest(F.col("box.xmax") - F.col("box.xmin"), F.col("box.ymax") - F.col("box.ymin")) + 2 * reach
    level = F.ceil(F.log2(F.greatest(wide, F.lit(1e-9))) / 2).cast("int")
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - reach) / _side(F.col("_lv"))), F.floor((F.col(hi) + reach) / _side(F.col("_lv")))))
    cells = polys.where("box.xmin is not null").withColumn("_lv", level).withColumn("_near", F.col("segs"))
    cells = cells.withColumn("_cx", span("box.xmin", "box.xmax")).withColumn("_cy", span("box.ymin", "box.ymax")).drop("box")
    settled = []
    for cut in range(rounds + 1):
        if cut:
            parts = F.sequence(F.lit(0), F.lit(3))
            cells = cells.withColumn("_lv", F.col("_lv") - 1)
            for c in ("_cx", "_cy"):
                cells = cells.withColumn("_part", F.explode(parts)).withColumn(c, F.col(c) * 4 + F.col("_part")).drop("_part")
        side = _side(F.col("_lv"))
        x, y = F.col("_cx") * side, F.col("_cy") * side
        cells = cells.withColumn("_near", F.filter("_near", _toucher(x, y, side, reach)))
        free = F.size("_near") == 0
        inner = cells.where(free & geo.contains_point("segs", x + side / 2, y + side / 2))
        settled.append(inner.select("_name", *CELL, F.lit(True).alias("_inner")))
        cells = cells.where(~free)
    out = cells.select("_name", *CELL, F.lit(False).alias("_inner"))
    for inner in settled:
        out = out.unionByName(inner)
    return out


def _candidates(places: DataFrame, polys: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Places with polygons they are inside of (``_x``, ``_y``, ``_name``), and with those to be tested (and ``segs``)."""
    cells = materialise(covering(polys, reach))
    # levels are logarithms of sizes: a handful of small numbers
    levels = sorted(r[0] for r in cells.select("_lv").distinct().collect())
    leveled = places.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in levels or [0]])))
    leveled = leveled.select("_x", "_y", "_lv", *[F.floor(F.col(v) / _side(F.col("_lv"))).alias(c) for v, c in (("_x", "_cx"), ("_y", "_cy"))])
    few = cells.count() <= FEW_CELLS
    met = leveled.join(F.broadcast(cells), CELL) if few else skew_join(leveled, cells, CELL)
    outlines = polys.select("_name", "segs")
    edge = met.where(~F.col("_inner")).select("_x", "_y", "_name")
    light = (polys.agg(F.sum(F.size("segs"))).first()[0] or 0) <= FEW_SEGMENTS
    tested = edge.join(F.broadcast(outlines), "_name") if light else skew_join(edge, outlines, ["_name"])
    return met.where("_inner").select("_x", "_y", "_name"), tested


def _places(points: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct known places as ``_x``, ``_y``."""
    known = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return known.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")).distinct()


def _back_to_points(points: DataFrame, x: str, y: str, found: DataFrame, how: str) -> DataFrame:
    """Join answers per place to the points there."""
    placed = points.withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    return skew_join(placed, found, ["_x", "_y"], how).drop("_x", "_y")


def contains_join(
    points: DataFrame, polys: DataFrame, x: str, y: str, name: str, out: str | None = None,
    unknown: str | None = UNKNOWN_PLACE,
) -> DataFrame:
    """Points with the name of the polygon they lie in.

    ``polys`` comes from :func:`prepare_polygons`. A point in several polygons gets the
    first name in order, a point in none gets ``unknown``.
    """
    out = out or name
    polys = polys.select(F.col(name).alias("_name"), "segs", "box")
    coords = _places(points, x, y)
    sure, open_ = _candidates(coords, polys, 0.0)
    inside = sure.unionByName(open_.where(geo.contains_point("segs", "_x", "_y")).select("_x", "_y", "_name"))
    named = inside.groupBy("_x", "_y").agg(F.min("_name").alias(out))
    joined = _back_to_points(points, x, y, named, "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(unknown))) if unknown is not None else joined


def within_distance_join(
    points: DataFrame, polys: DataFrame, key: str, x: str, y: str, name: str, miles: float,
    meters_per_mile: float = METERS_PER_MILE,
) -> DataFrame:
    """Pairs of polygon and point at most ``miles`` apart: ``key``, ``name``, ``distance``.

    Distances are exact; 0 inside a polygon.
    """
    radius = float(miles) * meters_per_mile
    polys = polys.select(F.col(name).alias("_name"), "segs", "box")
    coords = _places(points, x, y)
    sure, open_ = _candidates(coords, polys, radius)
    measured = open_.withColumn("distance", geo.distance_to_polygon("segs", "_x", "_y")).drop("segs")
    measured = measured.unionByName(sure.withColumn("distance", F.lit(0.0)))
    near = measured.where(F.col("distance") <= radius).select("_x", "_y", F.col("_name").alias(name), "distance")
    return _back_to_points(points.select(key, x, y), x, y, near, "inner").select(key, name, "distance")


class Boxes:
    """A packed tree of the boxes of polygons, with their segments: sort-tile order, ``FAN`` to a box."""

    def __init__(self, names: list, segments: list[np.ndarray]):
        box = np.array([[s[:, 0].min(), s[:, 1].min(), s[:, 0].max(), s[:, 1].max()] for s in segments]).reshape(-1, 4)
        middle = box[:, :2] + box[:, 2:]
        slabs = max(1, int(np.ceil(np.sqrt(len(box) / FAN))))
        slab = np.argsort(np.argsort(middle[:, 0], kind="stable"), kind="stable") * slabs // max(1, len(box))
        order = np.lexsort((middle[:, 1], slab))
        self.names = [names[i] for i in order]
        self.rank = np.argsort(np.argsort(np.array(self.names, dtype=object), kind="stable"), kind="stable")  # ties go to the first name
        sizes = np.array([len(segments[i]) for i in order], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.segments = np.concatenate([segments[i] for i in order]) if len(order) else np.zeros((0, 4))
        self.levels = [box[order]]
        while len(self.levels[0]) > FAN:
            low = self.levels[0]
            cuts = np.arange(0, len(low), FAN)
            self.levels.insert(0, np.column_stack([np.minimum.reduceat(low[:, :2], cuts), np.maximum.reduceat(low[:, 2:], cuts)]))

    def nearest(self, x: np.ndarray, y: np.ndarray, digits: int = TIE_DIGITS) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``names`` of the nearest polygon of each point, -1 without any, and the least distance.

        Of the polygons whose distances round alike it is the one with the first name.
        """
        best, far = np.full(len(x), -1), np.full(len(x), np.inf)
        step = max(1, PAIRS // (FAN * FAN * 4))
        for start in range(0, len(x), step):
            part = slice(start, start + step)
            best[part], far[part] = self._nearest(x[part], y[part], digits)
        return best, far

    def _nearest(self, x: np.ndarray, y: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        best, far, least = np.full(n, -1), np.full(n, np.inf), np.full(n, np.inf)  # least: far, rounded
        if not len(self.names):
            return best, far
        upper = np.full(n, np.inf)
        q, v = np.repeat(np.arange(n), len(self.levels[0])), np.tile(np.arange(len(self.levels[0])), n)
        for depth, boxes in enumerate(self.levels):
            if depth:
                q, v = np.repeat(q, FAN), (v[:, None] * FAN + np.arange(FAN)).ravel()
                q, v = q[v < len(boxes)], v[v < len(boxes)]
            low, high = bounds(x[q], y[q], boxes[v])
            np.minimum.at(upper, q, high)
            keep = low <= tie_bound(upper[q], digits)
            q, v, low = q[keep], v[keep], low[keep]
        # nearest boxes first, so that few outlines are measured: whole polygons at a time
        order = np.lexsort((low, q))
        q, v, low = q[order], v[order], low[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        for k in range(int(turn.max(initial=-1)) + 1):
            mine = np.flatnonzero((turn == k) & (low <= tie_bound(far[q], digits)))
            if not len(mine):
                break
            sizes = self.first[v[mine] + 1] - self.first[v[mine]]
            for cut in np.split(mine, np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1):
                d = self.distance(x[q[cut]], y[q[cut]], v[cut])
                p, r = q[cut], rounded(d, digits)
                better = (r < least[p]) | ((r == least[p]) & (self.rank[v[cut]] < self.rank[best[p]]))
                least[p[better]], best[p[better]] = r[better], v[cut][better]
                far[p] = np.minimum(far[p], d)
        return best, far

    def distance(self, x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Distance of each point to the polygon beside it, 0 inside (even-odd, half-open edges)."""
        sizes = self.first[v + 1] - self.first[v]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(self.first[v] - starts, sizes) + np.arange(sizes.sum())
        x1, y1, x2, y2 = self.segments[at].T
        px, py = np.repeat(x, sizes), np.repeat(y, sizes)
        dx, dy = x2 - x1, y2 - y1
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * dx / dy)
            along = np.nan_to_num(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))
        t = np.clip(along, 0, 1)
        gap = np.sqrt((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2)
        inside = np.add.reduceat(crosses.astype(np.int64), starts) % 2 == 1
        return np.where(inside, 0.0, np.minimum.reduceat(gap, starts))


def bounds(x: np.ndarray, y: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distance from points to what is in their boxes, each side of which something touches."""
    x1, y1, x2, y2 = box.T
    low = np.hypot(np.maximum(np.maximum(x1 - x, x - x2), 0), np.maximum(np.maximum(y1 - y, y - y2), 0))
    near_x, near_y = np.minimum(np.abs(x - x1), np.abs(x - x2)), np.minimum(np.abs(y - y1), np.abs(y - y2))
    far_x, far_y = np.maximum(np.abs(x - x1), np.abs(x - x2)), np.maximum(np.abs(y - y1), np.abs(y - y2))
    return low, np.minimum(np.hypot(near_x, far_y), np.hypot(far_x, near_y))


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Distances to ``digits`` decimals, halves away from zero, as SQL rounds doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = d * 10.0**digits
        whole = np.floor(scaled)
        out = (whole + (scaled - whole >= 0.5)) / 10.0**digits
    return np.where(np.isfinite(out), out, d)


def tie_bound(d: np.ndarray, digits: int) -> np.ndarray:
    """Up to where something may be as near as ``d`` once both are rounded."""
    return d * (1 + 1e-9) + 10.0**-digits


def _packed(polys: pa.Table | pa.RecordBatch) -> Boxes:
    names, outlines = polys.column("_name").to_pylist(), polys.column("segs").to_pylist()
    found = [(n, np.array([[g["x1"], g["y1"], g["x2"], g["y2"]] for g in s])) for n, s in zip(names, outlines) if s]
    return Boxes([n for n, _ in found], [s for _, s in found])


def _tiles(polys: DataFrame, n: int) -> DataFrame:
    """Polygons with the number of the piece they are in: slabs of x, cut by y, about n in all."""
    slabs = max(1, round(n**0.5))
    cut = [i / slabs for i in range(1, slabs)]
    if not cut:
        return polys.withColumn("_piece", F.lit(0))
    mid = polys.withColumn("_mx", F.col("box.xmin") / 2 + F.col("box.xmax") / 2).withColumn("_my", F.col("box.ymin") / 2 + F.col("box.ymax") / 2)
    below = lambda edges, v: F.size(F.filter(edges, lambda e: e < F.col(v)))
    mid = mid.withColumn("_edges", mid.agg(F.percentile_approx("_mx", cut)).scalar())
    mid = mid.withColumn("_slab", below(F.col("_edges"), "_mx")).drop("_edges")
    edges = mid.groupBy("_slab").agg(F.percentile_approx("_my", cut).alias("_edges"))
    placed = mid.join(F.broadcast(edges), "_slab")  # as many numbers as pieces
    return placed.withColumn("_piece", F.col("_slab") * slabs + below(F.col("_edges"), "_my")).drop("_mx", "_my", "_slab", "_edges")


def nearest_join(
    points: DataFrame, polys: DataFrame, x: str, y: str, name: str, few: int = FEW_SEGMENTS, digits: int = TIE_DIGITS,
) -> DataFrame:
    """Points with the nearest polygon's name and the least distance (0 inside); distances that agree to ``digits`` decimals tie, by name.

    Up to ``few`` segments all polygons are one broadcast tree. More are cut into pieces of about that many; each
    place goes to the pieces whose box is no farther than the least upper bound of all, and
    pieces with many places are searched by several tasks. There is no limit to the distance.
    """
    polys = polys.select(F.col(name).alias("_name"), "segs", "box").where(F.size("segs") > 0)
    places = _places(points, x, y)
    share_code(points.sparkSession)
    schema = T.StructType([T.StructField("_x", T.DoubleType()), T.StructField("_y", T.DoubleType()), polys.schema["_name"], T.StructField("distance", T.DoubleType())])

    def told(tree: Boxes, px: np.ndarray, py: np.ndarray, kind: pa.DataType) -> list[pa.Array]:
        best, far = tree.nearest(px, py, digits)
        found = best >= 0
        return [pa.array(px[found]), pa.array(py[found]), pa.array([tree.names[i] for i in best[found]], kind), pa.array(far[found])]

    segments = polys.agg(F.sum(F.size("segs"))).first()[0] or 0
    if segments <= few:
        held = polys.select("_name", "segs").toArrow()  # at most ``few`` segments
        kind, tree = held.schema.field("_name").type, points.sparkSession.sparkContext.broadcast(_packed(held))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(told(tree.value, batch.column("_x").to_numpy(), batch.column("_y").to_numpy(), kind), schema.names)

        best = spread_out(places).mapInArrow(search, schema)
    else:
        pieces = materialise(_tiles(polys, -(-segments // few)))
        ends = [F.min("box.xmin"), F.min("box.ymin"), F.max("box.xmax"), F.max("box.ymax")]
        rows = pieces.groupBy("_piece").agg(*ends).collect()  # as many as pieces
        number, box = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], dtype=np.float64)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, PAIRS // len(number))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    px, py = part.column("_x").to_numpy(), part.column("_y").to_numpy()
                    q, v = np.repeat(np.arange(len(px)), len(number)), np.tile(np.arange(len(number)), len(px))
                    low, high = (b.reshape(len(px), -1) for b in bounds(px[q], py[q], box[v]))
                    q, v = np.nonzero(low <= tie_bound(high.min(axis=1), digits)[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(px[q]), pa.array(py[q]), pa.array(number[v].astype(np.int32))], ["_x", "_y", "_piece"])

        asked = materialise(spread_out(places).mapInArrow(meet, "_x double, _y double, _piece int"))
        blocks = asked.groupBy("_piece").agg(F.ceil(F.count(F.lit(1)) / few).cast("int").alias("_blocks"))
        asked = asked.join(F.broadcast(blocks), "_piece").withColumn("_block", F.pmod(F.xxhash64("_x", "_y"), "_blocks").cast("int"))
        copies = pieces.join(F.broadcast(blocks), "_piece").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

        def search_piece(left: pa.Table, right: pa.Table) -> pa.Table:
            kind = right.schema.field("_name").type
            found = told(_packed(right), left.column("_x").to_numpy(), left.column("_y").to_numpy(), kind)
            return pa.Table.from_arrays([*found, pa.array(rounded(found[-1].to_numpy(), digits))], [*schema.names, "_near"])

        both = asked.groupBy("_piece", "_block").cogroup(copies.select("_piece", "_block", "_name", "segs").groupBy("_piece", "_block"))
        best = both.applyInArrow(search_piece, T.StructType([*schema.fields, T.StructField("_near", T.DoubleType())]))
        best = best.groupBy("_x", "_y").agg(F.min(F.struct("_near", "_name")).alias("_b"), F.min("distance").alias("distance"))
        best = best.select("_x", "_y", "_b._name", "distance")
    return _back_to_points(points, x, y, best.withColumnRenamed("_name", name), "left")
