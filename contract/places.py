"""Projection, polygons and spatial joins.

Polygons come from ``nation`` (squares, triangles and a square with a hole on a 5 x 5
board), points from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.base import case, load
from regdata.functions import geo
from regdata.operators import aggregate, spatial


def polygons(spark, d):
    n = load(spark, d, "nation")
    x0 = ((F.col("n_nationkey") % 5) * 10 - 25).cast("double")
    y0 = (F.floor(F.col("n_nationkey") / 5) * 10 - 25).cast("double")

    def ring(points):
        return F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in points])

    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    triangle = [(0, 0), (10, 0), (0, 10)]
    hole = [(3, 3), (3, 7), (7, 7), (7, 3), (3, 3)]
    rings = (
        F.when(F.col("n_regionkey") == 0, F.array(F.array(ring(triangle))))
        .when(F.col("n_regionkey") == 1, F.array(F.array(ring(square), ring(hole))))
        .otherwise(F.array(F.array(ring(square))))
    )
    return n.select("n_name", rings.alias("rings"))


def points(spark, d):
    e = load(spark, d, "embeddings")
    return e.select(
        "vec_id", (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"), "label"
    )


_EDGES = """
    with n as (select n_name, n_regionkey as r, (n_nationkey % 5) * 10.0::double - 25 as x0, (n_nationkey // 5) * 10.0::double - 25 as y0 from nation),
    c(r0, k, x1, y1, x2, y2) as (values
      ('s', 1, 0, 0, 10, 0), ('s', 2, 10, 0, 10, 10), ('s', 3, 10, 10, 0, 10), ('s', 4, 0, 10, 0, 0),
      ('t', 1, 0, 0, 10, 0), ('t', 2, 10, 0, 0, 10), ('t', 3, 0, 10, 0, 0),
      ('h', 1, 3, 3, 3, 7), ('h', 2, 3, 7, 7, 7), ('h', 3, 7, 7, 7, 3), ('h', 4, 7, 3, 3, 3)),
    e as (select n_name, x0 + x1 as x1, y0 + y1 as y1, x0 + x2 as x2, y0 + y2 as y2 from n join c on
        (r0 = 't' and r = 0) or (r0 = 's' and r <> 0) or (r0 = 'h' and r = 1)),
    p as (select vec_id, embedding[1]::double * 100 as x, embedding[2]::double * 100 as y, label from embeddings),
    pe as (select vec_id, label, x, y, n_name, (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) as hit,
        greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) as t, x1, y1, x2, y2 from p, e),
    pp as (select vec_id, label, n_name, sum(case when hit then 1 else 0 end) % 2 = 1 as inside,
        min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) as edge from pe group by all),
    dd as (select vec_id, label, n_name, inside, case when inside then 0 else edge end as distance from pp)
"""


@case("contains_join", _EDGES + """
    select p.vec_id, coalesce(min(n_name), '[UNKNOWN]') as n_name from p left join (select vec_id, n_name from dd where inside) i on i.vec_id = p.vec_id group by 1
""")
def contains_join(spark, d):
    polys = spatial.prepare_polygons(polygons(spark, d))
    return spatial.contains_join(points(spark, d), polys, "x", "y", "n_name").select("vec_id", "n_name")


@case("nearest_join", _EDGES + """
    select vec_id, arg_min(n_name, (round(distance, 9), n_name)) as n_name, round(min(distance), 6) as distance from dd group by 1
""")
def nearest_join(spark, d):
    polys = spatial.prepare_polygons(polygons(spark, d))
    out = spatial.nearest_join(points(spark, d), polys, "x", "y", "n_name")
    return out.select("vec_id", "n_name", F.round("distance", 6).alias("distance"))


@case("within_distance_join", _EDGES + """
    select vec_id, n_name, round(distance, 6) as distance from dd where distance <= 4.5
""")
def within_distance_join(spark, d):
    polys = spatial.prepare_polygons(polygons(spark, d))
    out = spatial.within_distance_join(points(spark, d), polys, "vec_id", "x", "y", "n_name", miles=4.5, meters_per_mile=1.0)
    return out.select("vec_id", "n_name", F.round("distance", 6).alias("distance"))


@case("smoothed_sources", _EDGES + """
    , w as (select vec_id, n_name, label, count(*) over (partition by vec_id) as dup from dd where distance <= 4.5)
    select n_name, round(sum(label * dup) / sum(dup), 8) as label, count(*) as n_sources from w group by 1
""")
def smoothed_sources(spark, d):
    polys = spatial.prepare_polygons(polygons(spark, d))
    pts = points(spark, d)
    pairs = spatial.within_distance_join(pts, polys, "vec_id", "x", "y", "n_name", miles=4.5, meters_per_mile=1.0)
    pairs = pairs.join(pts.select("vec_id", "label"), "vec_id")
    return aggregate.smooth(pairs, "n_name", "vec_id", ["label"]).withColumn("label", F.round("label", 8))


@case("polygon_centroids", _EDGES + """
    select n_name, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) as x,
      round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) as y, min(x1) as xmin, max(y1) as ymax from e group by 1
""")
def polygon_centroids(spark, d):
    polys = spatial.prepare_polygons(polygons(spark, d)).withColumn("c", geo.centroid("segs"))
    return polys.select("n_name", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.col("box.xmin").alias("xmin"), F.col("box.ymax").alias("ymax"))


@case("projected_points", """
    with k as (select 6378137.0::double as a, 1 / 298.257222101::double as f), ee as (select a, sqrt(2 * f - f * f) as e from k),
    m as (select a, e, cos(radians(34.0)) / sqrt(1 - pow(e * sin(radians(34.0)), 2)) as m1, cos(radians(40.5)) / sqrt(1 - pow(e * sin(radians(40.5)), 2)) as m2,
      (1 - e * e) * (sin(radians(34.0)) / (1 - pow(e * sin(radians(34.0)), 2)) - ln((1 - e * sin(radians(34.0))) / (1 + e * sin(radians(34.0)))) / (2 * e)) as q1,
      (1 - e * e) * (sin(radians(40.5)) / (1 - pow(e * sin(radians(40.5)), 2)) - ln((1 - e * sin(radians(40.5))) / (1 + e * sin(radians(40.5)))) / (2 * e)) as q2 from ee),
    c as (select a, e, (m1 * m1 - m2 * m2) / (q2 - q1) as n, m1, q1 from m), cc as (select a, e, n, m1 * m1 + n * q1 as cst from c),
    p as (select vec_id, -71 + embedding[1]::double as lon, 42 + embedding[2]::double as lat from embeddings),
    pq as (select vec_id, lon, lat, a, e, n, cst, (1 - e * e) * (sin(radians(lat)) / (1 - pow(e * sin(radians(lat)), 2)) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) as q from p, cc),
    r as (select *, a * sqrt(cst - n * q) / n as rho, n * radians(lon + 120) as th, a * sqrt(cst) / n as rho0 from pq)
    select vec_id, round(rho * sin(th), 3) as x, round(-4000000 + rho0 - rho * cos(th), 3) as y, round(lon, 6) as lon, round(lat, 6) as lat from r
""")
def projected_points(spark, d):
    e = load(spark, d, "embeddings").select(
        "vec_id", (F.col("embedding")[0].cast("double") - 71).alias("lon"), (F.col("embedding")[1].cast("double") + 42).alias("lat")
    )
    p = e.withColumn("m", geo.project_albers("lon", "lat"))
    back = geo.unproject_albers(F.col("m.x"), F.col("m.y"))
    return p.select("vec_id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"))


# --- the assignment reports, in degrees -> metres ------------------------------------------

def sql_metres(lon: str, lat: str) -> tuple[str, str]:
    """x and y of the projection with its constants worked out."""
    import math

    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    q = lambda s: (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s1, s2 = math.sin(math.radians(34.0)), math.sin(math.radians(40.5))
    m1 = math.cos(math.radians(34.0)) ** 2 / (1 - (e * s1) ** 2)
    m2 = math.cos(math.radians(40.5)) ** 2 / (1 - (e * s2) ** 2)
    n = (m1 - m2) / (q(s2) - q(s1))
    c = m1 + n * q(s1)
    s = f"sin(radians({lat}))"
    qs = f"({1 - e * e!r}::double * ({s} / (1 - pow({e!r}::double * {s}, 2)) - ln((1 - {e!r}::double * {s}) / (1 + {e!r}::double * {s})) / {2 * e!r}::double))"
    rho = f"({a / n!r}::double * sqrt({c!r}::double - {n!r}::double * {qs}))"
    theta = f"({n!r}::double * radians({lon} + 120))"
    return f"{rho} * sin({theta})", f"{a * math.sqrt(c) / n - 4000000!r}::double - {rho} * cos({theta})"


_X, _Y = sql_metres("lon", "lat")
_METRES = f"""
    with nn as (select n_nationkey as k, n_name, n_regionkey as r, -71 + ((n_nationkey % 5) * 0.1::double - 0.25) as lon0, 42 + ((n_nationkey // 5) * 0.1::double - 0.25) as lat0 from nation),
    c(i, dx, dy) as (values (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1)),
    ll as (select k, n_name, r, i, lon0 + dx * 0.1::double as lon, lat0 + dy * 0.1::double as lat from nn, c),
    v as (select k, n_name, r, i, {_X} as x, {_Y} as y from ll),
    e as (select a.k, a.n_name, a.r, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from v a join v b on a.k = b.k and b.i = a.i % 4 + 1),
    pl as (select vec_id, -71 + embedding[1]::double as lon, 42 + embedding[2]::double as lat, label * 1.5::double as volume from embeddings),
    p as (select vec_id, volume, {_X} as x, {_Y} as y from pl),
    pe as (select vec_id, volume, x, y, k, n_name, r, (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) as hit, x1, y1, x2, y2,
        greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) as t from p, e),
    pp as (select vec_id, volume, k, n_name, r, sum(case when hit then 1 else 0 end) % 2 = 1 as inside,
        min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) as edge from pe group by all),
    dd as (select vec_id, volume, k, n_name, r, case when inside then 0 else edge end as distance from pp)
"""


def census_polygons(spark, d):
    """Cells of 0.1 degrees, one per nation, as metric polygons."""
    from regdata.plans import discharge

    n = load(spark, d, "nation")
    lon0 = F.lit(-71.0) + ((F.col("n_nationkey") % 5) * F.lit(0.1) - 0.25)
    lat0 = F.lit(42.0) + (F.floor(F.col("n_nationkey") / 5) * F.lit(0.1) - 0.25)
    ring = F.array(*[F.struct((lon0 + dx * 0.1).alias("x"), (lat0 + dy * 0.1).alias("y")) for dx, dy in [(0, 0), (1, 0), (1, 1), (0, 1)]])
    return discharge.projected_polygons(n.select(F.col("n_name").alias("area"), "n_regionkey", F.array(F.array(ring)).alias("rings")))


def metric_sources(spark, d):
    from regdata.plans import discharge

    e = load(spark, d, "embeddings").select(
        F.col("vec_id").alias("outfall"), (F.col("embedding")[0].cast("double") - 71).alias("lon"), (F.col("embedding")[1].cast("double") + 42).alias("lat"),
        (F.col("label") * 1.5).alias("volume"), F.lit(1.0).alias("n"),
    )
    return discharge.projected(e)


@case("report_assign_sources", _METRES + """
    select vec_id as outfall, arg_min(n_name, (round(distance, 6), n_name)) as area, round(min(distance), 3) as distance from dd where r <> 3 group by 1
""")
def report_assign_sources(spark, d):
    from regdata.plans import discharge

    polys = census_polygons(spark, d)
    areas = polys.where("n_regionkey <> 3").select("area")  # areas without demographic rows take no source
    out = discharge.assign_sources(metric_sources(spark, d), polys, areas)
    return out.select("outfall", "area", F.round("distance", 3).alias("distance"))


@case("report_smoothed_areas", _METRES + """
    , w as (select vec_id, n_name, volume, count(*) over (partition by vec_id) as dup from dd where distance <= 1.5 * 1609.34::double)
    select n.n_name as area, round(sum(volume * dup) / sum(dup), 8) as volume, count(vec_id) as n_sources from nation n left join w on w.n_name = n.n_name group by 1
""")
def report_smoothed_areas(spark, d):
    from regdata.plans import discharge

    polys = census_polygons(spark, d)
    out = discharge.sources_near_areas(metric_sources(spark, d), polys, polys.select("area"), 1.5)
    return out.select("area", F.round("volume", 8).alias("volume"), "n_sources")


@case("report_assign_areas", f"""
    with nn as (select n_name, n_nationkey as k from nation)
    select n_name as area, case when k // 5 = 4 then '[UNKNOWN]' else 'Town ' || (k % 5) end as town, 'Basin ' || (k // 5) as watershed from nn
""")
def report_assign_areas(spark, d):
    """Towns are the columns of the board without its top row, watersheds its rows."""
    from regdata.plans import discharge

    n = load(spark, d, "nation")

    def box(lon0, lon1, lat0, lat1):
        at = lambda v: v if not isinstance(v, float) else F.lit(v)
        corners = [(lon0, lat0), (lon1, lat0), (lon1, lat1), (lon0, lat1)]
        return F.array(F.array(F.array(*[F.struct(at(x).alias("x"), at(y).alias("y")) for x, y in corners])))

    columns = n.select((F.col("n_nationkey") % 5).alias("c")).distinct()
    rows = n.select(F.floor(F.col("n_nationkey") / 5).alias("r")).distinct()
    column, row = F.col("c"), F.col("r")
    west, south = column * 0.1 - 71.25, row * 0.1 + 41.75
    towns = columns.select(F.concat(F.lit("Town "), column).alias("town"), box(west, west + 0.1, 41.75, 42.15).alias("rings"))
    basins = rows.select(F.concat(F.lit("Basin "), row).alias("watershed"), box(-71.25, -70.75, south, south + 0.1).alias("rings"))
    polys = census_polygons(spark, d)
    return discharge.assign_areas(polys.select("area"), polys, discharge.projected_polygons(towns), discharge.projected_polygons(basins))
