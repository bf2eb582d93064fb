"""Nearest polygons that are equally near but for the last bits of the distance."""

import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from contract import CASES
from contract.compare import compare, duck
from regdata.functions import geo
from regdata.operators import spatial

SOURCE = "/root/testdata/sf0.001"


def polygons(spark, rings):
    return spatial.prepare_polygons(spark.createDataFrame([(n, [[r]]) for n, r in rings.items()], f"name string, rings {geo.POLYGON}"))


def found(spark, places, polys, **options):
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "id long, x double, y double")
    rows = spatial.nearest_join(points, polys, "x", "y", "name", **options).collect()
    return {r.id: (r.name, r.distance) for r in rows}


@pytest.mark.parametrize("few", [spatial.FEW_SEGMENTS, 3])  # one tree, and a piece for every polygon or so
def test_a_shared_corner_goes_to_the_first_name(spark, few):
    x0, y0 = 3892557.3931, 1469450.4172
    rings = {}
    for name, angle, ulps in (("d", 0.1, 1), ("b", 0.5, 0), ("c", 0.9, 2)):  # triangles that share a corner, worked out three ways
        rings[name] = [(x0 + ulps * math.ulp(x0), y0), *[(x0 - 700 * math.cos(angle + turn), y0 - 700 * math.sin(angle + turn)) for turn in (0.0, 0.37)]]
    rings["a"] = [(x - 9000, y) for x, y in rings["b"]]  # far from all
    rng = np.random.default_rng(4)
    angle, far = rng.uniform(0.5, 0.8, 300), rng.uniform(1, 5000, 300)
    got = found(spark, zip(x0 + far * np.cos(angle), y0 + far * np.sin(angle)), polygons(spark, rings), few=few, digits=6)
    assert {name for name, _ in got.values()} == {"b"}
    assert all(got[i][1] == pytest.approx(far[i], abs=1e-8) for i in range(300))


@pytest.mark.parametrize("few", [spatial.FEW_SEGMENTS, 3])
def test_distances_tie_when_they_round_alike(spark, few):
    """The distance stays the least one, whichever polygon has the name; no polygon that ties is left out early."""
    gap = 3e-7
    rings = {n: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)] for n, x in (("b", 0.0), ("a", 1 + gap), ("c", -1.0))}
    places = [(0.5, 0.5), (1 - 1e-7, 0.5), (1 - 3e-7, 0.5), (1.0, 5.0), (1 + gap, -3.0), (-0.5, 2.0)]
    polys = polygons(spark, rings)
    got = found(spark, places, polys, few=few, digits=6)
    assert [got[i][0] for i in range(6)] == ["b", "a", "b", "a", "a", "c"]
    assert [got[i][1] for i in range(6)] == [0.0, 0.0, 0.0, 4.0, 3.0, 1.0]
    assert found(spark, places, polys, few=few, digits=9)[1] == ("b", 0.0)


def test_rounding_is_that_of_sql():
    import duckdb

    rng = np.random.default_rng(2)
    d = np.concatenate([rng.uniform(0, 3e4, 20000), rng.integers(0, 10**7, 20000) * 1e-6 + 5e-7, [0.0, 5e-7, 4.5e9 + 0.3, 1e300, math.inf]])
    con = duckdb.connect()
    con.register("t", pa.table({"i": np.arange(len(d)), "d": d}))
    for digits in (3, 6, 9):
        want = [r[0] for r in con.execute(f"select round(d, {digits}) from t order by i").fetchall()]
        assert spatial.rounded(d, digits).tolist() == want


@pytest.mark.skipif(not os.path.isdir(SOURCE), reason="driver tables are not here")
def test_sources_near_shared_corners_agree_with_sql(spark, tmp_path):
    """Places found among millions: their two nearest areas differ in the last bits, or the third decimal hangs on those."""
    places = [
        (-0.050014808773994446, -0.28372466564178467), (0.07858636975288391, 0.14999714493751526), (-0.05000423267483711, -0.28149059414863586),
        (-0.049954839050769806, -0.3594907522201538), (-0.04999682307243347, -0.2753406763076782), (0.1110282689332962, 0.04999425634741783),
        (-0.04995475709438324, -0.3210951089859009), (0.09348705410957336, 0.04999275505542755), (-0.3232966363430023, -0.15002109110355377),
        (-0.33534687757492065, -0.05002932250499725), (0.10782460868358612, -0.15000681579113007), (0.1084834560751915, 0.15406781435012817),
    ]
    for name in os.listdir(SOURCE):
        if name != "embeddings.parquet":
            os.symlink(f"{SOURCE}/{name}", tmp_path / name)
    embedding = pa.array([list(p) for p in places], pa.list_(pa.float32()))
    n = len(places)
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": embedding, "label": pa.array([1] * n, pa.int32())}), tmp_path / "embeddings.parquet")
    assert compare(spark, duck(str(tmp_path)), str(tmp_path), CASES["report_assign_sources"]) == ("ok", n)
