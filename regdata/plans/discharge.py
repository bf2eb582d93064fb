"""Discharge against demographics by census area, town and watershed.

``sources`` has ``outfall``, ``lon``, ``lat``, ``volume`` and ``n``; ``areas`` has ``area``, ``pop`` and
indicator columns, and, once assigned, ``town`` and ``watershed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdata.functions import geo
from regdata.functions.nulls import known_keys, sum0
from regdata.operators import aggregate, doseresponse, quantile, relate, resample, spatial
from regdata.session import materialise
from regdata.vocab import BAND_SD, MIN_POPULATION


def projected(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add metric ``x`` and ``y``."""
    return df.withColumn("_p", geo.project_albers(lon, lat, squared=True)).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")


def projected_polygons(polys: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons in degrees to prepared metric polygons."""
    to_metres = F.transform(
        rings, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: geo.project_albers(p["x"], p["y"], squared=True)))
    )
    return spatial.prepare_polygons(polys.withColumn(rings, to_metres), rings)


def assign_sources(sources: DataFrame, area_polys: DataFrame, areas: DataFrame) -> DataFrame:
    """Sources with the nearest area that has demographic rows; areas equally near to a micrometre go by name."""
    polys = relate.known_members(area_polys, areas.select("area").distinct(), ["area"])
    return spatial.nearest_join(sources, polys, "x", "y", "area", digits=6)


def sources_near_areas(sources: DataFrame, area_polys: DataFrame, areas: DataFrame, miles: float) -> DataFrame:
    """Smoothed discharge per area from all sources within ``miles``; areas without any get 0 sources."""
    polys = relate.known_members(area_polys, areas.select("area").distinct(), ["area"])
    pairs = spatial.within_distance_join(sources, polys, "outfall", "x", "y", "area", miles)
    pairs = materialise(pairs.join(sources.select("outfall", "volume", "n"), "outfall"))
    smoothed = aggregate.smooth(pairs, "area", "outfall", ["volume", "n"])
    return relate.align_to_spine(smoothed, areas.select("area").distinct(), ["area"], {"n_sources": 0})


def assign_areas(areas: DataFrame, area_polys: DataFrame, towns: DataFrame, watersheds: DataFrame) -> DataFrame:
    """Areas with the town and watershed that contain the centre of their polygon."""
    centres = area_polys.join(areas.select("area").distinct(), "area", "right").select("area", geo.centroid("segs").alias("c"))
    centres = centres.select("area", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    placed = spatial.contains_join(centres, towns, "x", "y", "town")
    placed = spatial.contains_join(placed, watersheds, "x", "y", "watershed")
    return areas.join(placed.select("area", "town", "watershed"), "area", "left")


def discharge_by_area(sources: DataFrame) -> DataFrame:
    return aggregate.sum_by(sources, ["area"], ["volume", "n"])


def discharge_by(sources: DataFrame, areas: DataFrame, level: str) -> DataFrame:
    """Totals per town or watershed; places without discharge stay with 0."""
    return relate.facts_on_dimension(sources, areas, "area", "area", level, ["volume", "n"])


def discharge_per_water_body(sources: DataFrame, areas: DataFrame) -> DataFrame:
    """Totals per watershed, water body and outfall."""
    joined = sources.join(areas.select("area", "watershed"), "area", "left")
    return aggregate.sum_by(joined, ["watershed", "water_body", "outfall"], ["volume"])


def demographics_by(areas: DataFrame, level: str, indicators: list[str], null_policy: str = "match") -> DataFrame:
    """Population-weighted indicators per town or watershed."""
    return aggregate.weighted_mean(areas, [level], indicators, "pop", null_policy)


def level_table(sources: DataFrame, areas: DataFrame, level: str, indicators: list[str], fill: float | None = 0.0) -> DataFrame:
    """Discharge, indicators and population per unit of a level.

    ``fill`` is the discharge of a unit without sources: 0 for towns and watersheds and in
    the fit, null for single areas in the binned report.
    """
    # a gap keeps its weight among other areas; an area alone has no value then
    demo = demographics_by(areas, level, indicators, "strict" if level == "area" else "match")
    pop = known_keys(areas, level).groupBy(level).agg(sum0("pop").alias("pop"))
    found = known_keys(sources.join(areas.select("area", *({level} - {"area"})), "area", "inner"), level)
    volume = found.groupBy(level).agg(sum0("volume").alias("volume"))
    out = demo.join(pop, level).join(volume, level, "left")
    return out.withColumn("volume", F.coalesce("volume", F.lit(fill))) if fill is not None else out


def discharge_by_indicator_bin(
    table: DataFrame, indicator: str, key: str, bins: int = 4, reps: int = 1000, seed: int = 0, method: str = "draws",
) -> DataFrame:
    """Population-weighted mean discharge per indicator bin with a resampled band."""
    table = materialise(table)  # one row per unit, read by every step below
    binned = quantile.quantile_bin(table, indicator, bins, distinct=True, centre="centre")
    return resample.wmean_bootstrap(binned, ["bin", "centre"], "volume", "pop", key, reps, seed, method, BAND_SD)


def discharge_panels(
    tables: dict[str, DataFrame], indicators: list[str], bins: int = 4, reps: int = 1000, seed: int = 0, method: str = "draws",
) -> DataFrame:
    """:func:`discharge_by_indicator_bin` for every level and indicator, in one pass: a unit has a row per
    indicator, edges are quantiles per (level, indicator), and one bootstrap serves all bins."""
    rows = []
    for level, table in tables.items():
        pairs = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).cast("double").alias("x")) for i in indicators])
        rows.append(table.select(F.lit(level).alias("level"), F.col(level).cast("string").alias("key"), "volume", "pop", F.inline(pairs)))
    data, by = materialise(relate.union_all(rows)), ["level", "indicator"]
    edges = quantile.quantiles(data, by, "x", [i / bins for i in range(bins + 1)], [f"e{i}" for i in range(bins + 1)])
    edges = edges.select(*by, F.array_distinct(F.array(*[f"e{i}" for i in range(bins + 1)])).alias("edges"))
    binned = quantile.with_bin(data.join(F.broadcast(edges), by), "x", F.col("edges"), centre="centre").drop("edges")  # one row per panel
    return resample.wmean_bootstrap(binned, [*by, "bin", "centre"], "volume", "pop", "key", reps, seed, method, BAND_SD)


def dependence_facts(
    tables: dict[str, DataFrame], indicators: list[str], min_population: float = MIN_POPULATION, skip_unknown: bool = False,
) -> DataFrame:
    """Doubling ratio of discharge for every level and indicator: median, 5% and 95%.

    All fits share one pass: the level tables become rows (level, indicator, x, y, pop). A unit without
    an indicator is an error, or no part of that fit with ``skip_unknown``.
    """
    rows = []
    for level, table in tables.items():
        pairs = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).cast("double").alias("x")) for i in indicators])
        rows.append(table.select(F.lit(level).alias("level"), "volume", "pop", F.inline(pairs)))
    data = doseresponse.populated(relate.union_all(rows), "pop", min_population)
    known = data.where("x is not null") if skip_unknown else doseresponse.require_known(data, ["x"])
    data = materialise(known)  # one row per unit and indicator
    return doseresponse.powerlaw_posterior(data, ["level", "indicator"], "x", "volume", "pop", [0.5, 0.05, 0.95], ["median", "low", "high"])
