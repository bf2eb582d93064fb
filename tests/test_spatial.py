"""Spatial joins against brute force over random polygons, with a crowded cell and far points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regdata.functions import geo
from regdata.operators import spatial


def in_ring(ring, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def to_edge(ring, x, y):
    best = math.inf
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        d2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d2)) if d2 else 0.0
        best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
    return best


def distance(ring, x, y):
    return 0.0 if in_ring(ring, x, y) else to_edge(ring, x, y)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(8)
    rings = {}
    for i in range(30):
        cx, cy, r = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(1, 6)
        angles = np.sort(rng.uniform(0, 2 * math.pi, rng.integers(3, 8)))
        rings[f"p{i:02d}"] = [(float(cx + r * math.cos(a)), float(cy + r * math.sin(a))) for a in angles]
    rings["huge"] = [(-300.0, -300.0), (300.0, -310.0), (290.0, -200.0), (-300.0, -250.0)]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-60, 60, (150, 2)))]
    pts += [(1000 + i, 7.25, 7.5) for i in range(100)]  # copies of one place
    pts += [(2000, 5000.0, -4000.0), (2001, -900.0, 20.0), (2002, 0.0, -260.0)]  # far away, and inside the huge one
    polys = spark.createDataFrame(
        [(n, [[[(x, y) for x, y in r]]]) for n, r in rings.items()], f"name string, rings {geo.POLYGON}"
    )
    points = spark.createDataFrame(pts + [(3000, None, 1.0)], "id long, x double, y double")
    return rings, pts, points, spatial.prepare_polygons(polys)


@pytest.fixture(params=["planned", "split"])
def join_mode(spark, request, monkeypatch):
    """With Spark free to broadcast, and with every join salted and shuffled."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "split":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        monkeypatch.setattr(spatial, "FEW_CELLS", -1)
        monkeypatch.setattr(spatial, "FEW_SEGMENTS", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_contains(world, join_mode):
    rings, pts, points, polys = world
    got = {r.id: r.name for r in spatial.contains_join(points, polys, "x", "y", "name").collect()}
    for i, x, y in pts:
        assert got[i] == min((n for n, r in rings.items() if in_ring(r, x, y)), default="[UNKNOWN]")
    assert got[3000] == "[UNKNOWN]" and len(got) == len(pts) + 1


def test_nearest(world, join_mode):
    rings, pts, points, polys = world
    rows = spatial.nearest_join(points, polys, "x", "y", "name", few=20 if spatial.FEW_SEGMENTS < 0 else spatial.FEW_SEGMENTS).collect()
    got = {r.id: (r.name, r.distance) for r in rows}
    assert len(rows) == len(got) == len(pts) + 1 and got[3000] == (None, None)
    for i, x, y in pts:
        d, name = min((distance(r, x, y), n) for n, r in rings.items())
        assert got[i][1] == pytest.approx(d, abs=1e-9) and got[i][0] == name


def test_within_distance(world, join_mode):
    rings, pts, points, polys = world
    got = {(r.id, r.name): r.distance for r in spatial.within_distance_join(points, polys, "id", "x", "y", "name", 3, 1.5).collect()}
    want = {(i, n): distance(r, x, y) for i, x, y in pts for n, r in rings.items() if distance(r, x, y) <= 4.5}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_covering_is_bounded_and_whole(world):
    """A polygon ten thousand times the size of others has as many cells; inner cells are inside, and no place near it is left out."""
    rings, _, _, polys = world
    spark = polys.sparkSession
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    sizes = spark.createDataFrame([("small", [[square]]), ("large", [[[(x * 1e4 + 3, y * 1e4 + 7) for x, y in square]]])], f"name string, rings {geo.POLYGON}")
    counts = {r[0]: r[1] for r in spatial.covering(spatial.prepare_polygons(sizes).withColumnRenamed("name", "_name")).groupBy("_name").count().collect()}
    assert set(counts) == {"small", "large"} and max(counts.values()) <= 4 * 16**spatial.ROUNDS
    rng = np.random.default_rng(3)
    for reach in (0.0, 4.5):
        cells = {}
        for r in spatial.covering(polys.withColumnRenamed("name", "_name"), reach).collect():
            cells.setdefault(r["_name"], {})[r["_lv"], r["_cx"], r["_cy"]] = r["_inner"]
        assert all(len(c) <= 4 * 16**spatial.ROUNDS for c in cells.values()) and (reach or any(any(c.values()) for c in cells.values()))
        for name in ("huge", "p03", "p17"):
            ring = np.array(rings[name])
            for x, y in rng.uniform(ring.min(axis=0) - 6, ring.max(axis=0) + 6, (200, 2)):
                own = [v for (lv, cx, cy), v in cells[name].items() if (math.floor(x / 4.0**lv), math.floor(y / 4.0**lv)) == (cx, cy)]
                d = distance(rings[name], x, y)
                assert len(own) <= 1 and (own or d > reach or (reach == 0 and not in_ring(rings[name], x, y)))
                assert own != [True] or in_ring(rings[name], x, y)


def test_tree_of_boxes_matches_a_scan():
    """Many polygons, ties of equal polygons, points inside, on and far from them."""
    rng = np.random.default_rng(6)
    rings = [[(float(cx), float(cy)), (float(cx + w), float(cy)), (float(cx), float(cy + w))] for cx, cy, w in zip(*rng.uniform(-9, 9, (2, 500)), rng.uniform(0.01, 2, 500))]
    rings += rings[:20]
    outlines = [np.array([(*a, *b) for a, b in zip(r, r[1:] + r[:1])]) for r in rings]
    names = [f"n{i:03d}" for i in rng.permutation(len(rings))]
    tree = spatial.Boxes(names, outlines)
    x, y = rng.uniform(-20, 20, (2, 300))
    best, far = tree.nearest(x, y)
    for i in range(300):
        d, n = min((distance(r, x[i], y[i]), n) for r, n in zip(rings, names))
        assert far[i] == pytest.approx(d, abs=1e-12) and tree.names[best[i]] == n
    none = spatial.Boxes([], []).nearest(x, y)
    assert (none[0] == -1).all() and np.isinf(none[1]).all()


def test_no_polygons(spark, world):
    _, pts, points, polys = world
    none = polys.limit(0)
    assert {r.name for r in spatial.contains_join(points, none, "x", "y", "name").collect()} == {"[UNKNOWN]"}
    assert {r.name for r in spatial.nearest_join(points, none, "x", "y", "name").collect()} == {None}
    assert spatial.within_distance_join(points, none, "id", "x", "y", "name", 3).count() == 0


def test_tiling_assigns_each_point_once(spark):
    squares = [(f"s{i}{j}", [[[(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0)]]]) for i in range(3) for j in range(3)]
    polys = spatial.prepare_polygons(spark.createDataFrame(squares, f"name string, rings {geo.POLYGON}"))
    on_edges = [(k, x / 2, y / 2) for k, (x, y) in enumerate((x, y) for x in range(6) for y in range(6))]
    points = spark.createDataFrame(on_edges, "id long, x double, y double")
    names = {r.id: r.name for r in spatial.contains_join(points, polys, "x", "y", "name").collect()}
    assert all(names[k] == f"s{int(x)}{int(y)}" for k, x, y in on_edges)


def test_centroid_with_hole_and_far_origin(spark):
    outer = [(1e6, 0.0), (1e6 + 4, 0.0), (1e6 + 4, 4.0), (1e6, 4.0)]
    hole = [(1e6 + 2, 1.0), (1e6 + 2, 3.0), (1e6 + 3, 3.0), (1e6 + 3, 1.0)]
    df = spark.createDataFrame([([[outer, hole]],)], f"rings {geo.POLYGON}")
    c = df.select(geo.centroid(geo.flat_segments("rings")).alias("c")).first().c
    assert c.x == pytest.approx(1e6 + (16 * 2 - 2 * 2.5) / 14, abs=1e-9) and c.y == pytest.approx(2.0)


def test_projection_round_trip_and_area(spark):
    df = spark.createDataFrame([(-71.06, 42.36), (-120.0, 0.0), (-119.0, 37.0)], "lon double, lat double")
    p = df.withColumn("m", geo.project_albers("lon", "lat"))
    back = p.select("lon", "lat", "m", geo.unproject_albers(F.col("m.x"), F.col("m.y")).alias("b")).collect()
    for r in back:
        assert r.b.lon == pytest.approx(r.lon, abs=1e-10) and r.b.lat == pytest.approx(r.lat, abs=1e-10)
    origin = [r for r in back if r.lat == 0.0][0].m
    assert origin.x == pytest.approx(0.0, abs=1e-6) and origin.y == pytest.approx(-4000000.0, abs=1e-6)
    # equal-area: a small cell keeps its ellipsoidal area
    lat, d = math.radians(42.0), 1e-3
    e2 = 2 / 298.257222101 - (1 / 298.257222101) ** 2
    n, m = 6378137 / math.sqrt(1 - e2 * math.sin(lat) ** 2), 6378137 * (1 - e2) / (1 - e2 * math.sin(lat) ** 2) ** 1.5
    want = n * math.cos(lat) * m * math.radians(d) ** 2
    cell = [(-71.0, 42 - d / 2), (-71.0 + d, 42 - d / 2), (-71.0 + d, 42 + d / 2), (-71.0, 42 + d / 2)]
    xy = [tuple(r.m) for r in spark.createDataFrame(cell, "lon double, lat double").select(geo.project_albers("lon", "lat").alias("m")).collect()]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:] + xy[:1]))) / 2
    assert area == pytest.approx(want, rel=1e-6)
