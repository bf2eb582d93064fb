"""Projection and polygon geometry as column maths.

A polygon is ``rings``: array (parts) of array (rings) of array of struct(x, y).
``segments`` is the same outline flattened to array of struct(x1, y1, x2, y2); the
even-odd rule over all segments covers holes and several parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from regdata.functions.clean import _c
from regdata.vocab import ALBERS, ELLIPSOID

POLYGON = "array<array<array<struct<x:double,y:double>>>>"


def _cone(params: dict, ellipsoid: dict, squared: bool = False):
    """Constants of an equal-area cone: (a, e, n, C, rho0); ``squared`` takes squares of widths without their roots."""
    a, f = ellipsoid["a"], ellipsoid["f"]
    e = math.sqrt(2 * f - f * f)

    def area(phi):
        s = math.sin(phi)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def width2(phi):
        rest = 1 - (e * math.sin(phi)) ** 2
        return math.cos(phi) ** 2 / rest if squared else (math.cos(phi) / math.sqrt(rest)) ** 2

    lat0, lat1, lat2 = (math.radians(params[k]) for k in ("lat0", "lat1", "lat2"))
    n = (width2(lat1) - width2(lat2)) / (area(lat2) - area(lat1))
    big_c = width2(lat1) + n * area(lat1)
    return a, e, n, big_c, a * math.sqrt(big_c - n * area(lat0)) / n


def project_albers(lon, lat, params: dict = ALBERS, ellipsoid: dict = ELLIPSOID, squared: bool = False) -> Column:
    """Degrees to metres on an ellipsoidal equal-area cone, as struct(x, y).

    With ``squared`` the cone's constants are rounded less often, which moves x and y by some nanometres.
    """
    a, e, n, big_c, rho0 = _cone(params, ellipsoid, squared)
    s = F.sin(F.radians(_c(lat)))
    area = F.lit(1 - e * e) * (
        s / (1 - F.pow(s * e, F.lit(2.0))) - F.ln((1 - s * e) / (1 + s * e)) / F.lit(2 * e)
    )
    rho = F.sqrt(F.lit(big_c) - area * n) * F.lit(a / n)
    theta = F.radians(_c(lon) - params["lon0"]) * n
    return F.struct(
        (rho * F.sin(theta) + params["false_east"]).alias("x"),
        (F.lit(rho0 + params["false_north"]) - rho * F.cos(theta)).alias("y"),
    )


def unproject_albers(x, y, params: dict = ALBERS, ellipsoid: dict = ELLIPSOID) -> Column:
    """Inverse of :func:`project_albers`, as struct(lon, lat), by the authalic-latitude series."""
    a, e, n, big_c, rho0 = _cone(params, ellipsoid)
    dx = _c(x) - params["false_east"]
    dy = F.lit(rho0 + params["false_north"]) - _c(y)
    rho2 = (dx * dx + dy * dy) * F.lit((n / a) ** 2)
    area = (F.lit(big_c) - rho2) / F.lit(n)
    polar = (1 - e * e) * (1 / (1 - e * e) - math.log((1 - e) / (1 + e)) / (2 * e))
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), area / F.lit(polar))))
    e2, e4, e6 = e**2, e**4, e**6
    lat = (
        beta
        + F.sin(beta * 2) * F.lit(e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040)
        + F.sin(beta * 4) * F.lit(23 * e4 / 360 + 251 * e6 / 3780)
        + F.sin(beta * 6) * F.lit(761 * e6 / 45360)
    )
    # one Newton step on the exact equation takes the series to full precision
    s = F.sin(lat)
    inner = 1 - s * s * e2
    miss = area / (1 - e2) - s / inner + F.ln((1 - s * e) / (1 + s * e)) / F.lit(2 * e)
    lat = lat + inner * inner / (F.cos(lat) * 2) * miss
    return F.struct(
        (F.degrees(F.atan2(dx, dy) / F.lit(n)) + params["lon0"]).alias("lon"),
        F.degrees(lat).alias("lat"),
    )


def segments(rings) -> Column:
    """Outline of a polygon; open rings are closed."""

    def outline(ring):
        following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            following,
            lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
        )

    return F.transform(F.flatten(_c(rings)), outline)


def flat_segments(rings) -> Column:
    return F.flatten(segments(rings))


def contains_point(segs, x, y) -> Column:
    """Even-odd rule with half-open edges, so a shared edge belongs to one side only."""
    px, py = _c(x), _c(y)

    def crosses(s):
        at = s["x1"] + F.try_divide((py - s["y1"]) * (s["x2"] - s["x1"]), s["y2"] - s["y1"])
        return F.coalesce(((s["y1"] > py) != (s["y2"] > py)) & (px < at), F.lit(False))

    return F.size(F.filter(_c(segs), crosses)) % 2 == 1


def distance_to_outline(segs, x, y) -> Column:
    """Shortest distance from a point to any segment."""
    px, py = _c(x), _c(y)

    def distance(s):
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        along = F.try_divide((px - s["x1"]) * dx + (py - s["y1"]) * dy, dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        ex, ey = px - s["x1"] - t * dx, py - s["y1"] - t * dy
        return F.sqrt(ex * ex + ey * ey)

    return F.array_min(F.transform(_c(segs), distance))


def distance_to_polygon(segs, x, y) -> Column:
    """0 inside, otherwise the distance to the outline."""
    return F.when(contains_point(segs, x, y), 0.0).otherwise(distance_to_outline(segs, x, y))


def bounds(segs) -> Column:
    """struct(xmin, ymin, xmax, ymax) of an outline."""
    xs = F.transform(_c(segs), lambda s: s["x1"])
    ys = F.transform(_c(segs), lambda s: s["y1"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def centroid(segs) -> Column:
    """Area centroid by the shoelace sums, as struct(x, y).

    Rings must be wound as in GeoJSON (holes opposite to shells). Coordinates are
    taken relative to the first vertex so that large offsets do not cancel digits.
    """
    x0 = F.try_element_at(_c(segs), F.lit(1))["x1"]
    y0 = F.try_element_at(_c(segs), F.lit(1))["y1"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def add(acc, s):
        ax, ay, bx, by = s["x1"] - x0, s["y1"] - y0, s["x2"] - x0, s["y2"] - y0
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["cx"] + (ax + bx) * cross).alias("cx"),
            (acc["cy"] + (ay + by) * cross).alias("cy"),
        )

    total = F.aggregate(_c(segs), zero, add)
    return F.struct(
        (x0 + F.try_divide(total["cx"], total["a"] * 3)).alias("x"),
        (y0 + F.try_divide(total["cy"], total["a"] * 3)).alias("y"),
    )
