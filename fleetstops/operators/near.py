"""Distances between positions: a grid-cell join for "within so many metres", and bounds taken from another table.

Two positions within ``radius_m`` of each other are in the same or in neighbouring cells of a grid whose bands of
latitude and steps of longitude are no narrower than the radius. One side stands in its own cell, the other is
replicated to the cells around its own, so that an equality join on the cell finds every pair, and the exact
great-circle distance decides. Bands have steps of their own width, as degrees of longitude get shorter towards the
poles; steps are numbered around the globe, so positions on both sides of the 180th meridian meet.

The replicated side should be the smaller one (nine rows each). Both sides are dealt by the cell, which lets Spark split
the rows of a crowded cell over several tasks. Positions with a NULL, NaN or impossible coordinate are near nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Beyond this latitude a band is one cell.
POLAR = 89.0
CELL = "_fs_cell"


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres (haversine form) of two positions in degrees."""
    a1, o1, a2, o2 = (F.radians(F.col(c) if isinstance(c, str) else c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _band_degrees(radius_m: float) -> float:
    # A trifle wider than the radius, so that rounding never moves a neighbour two bands away.
    return math.degrees(radius_m / EARTH_M) * 1.000001


def _steps(band: Column, radius_m: float) -> Column:
    """How many steps of longitude a band has: each no narrower than the radius is anywhere in it or its neighbours."""
    wide = F.lit(_band_degrees(radius_m))
    highest = F.greatest(F.abs((band - 1) * wide), F.abs((band + 2) * wide))
    reach = F.degrees(2 * F.asin(F.least(F.sin(F.lit(radius_m / EARTH_M / 2)) / F.cos(F.radians(highest)), F.lit(1.0))))
    return F.when(highest >= POLAR, 1).otherwise(F.greatest(F.floor(F.lit(360 / 1.000001) / reach), F.lit(1))).cast("long")


def _valid(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) <= 90) & (F.abs(lon) <= 360)  # false or NULL for NaN and NULL as well


def _step(lon: Column, steps: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / F.lit(360.0) * steps), steps)


def cell_of(lat, lon, radius_m: float) -> Column:
    """The cell of a position, as one number (band and step); NULL for an impossible position. It can be stored."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    band = F.floor(lat / F.lit(_band_degrees(radius_m)))
    return F.when(_valid(lat, lon), band * F.lit(1 << 32) + _step(lon, _steps(band, radius_m))).cast("long")


def cells_around(lat, lon, radius_m: float) -> Column:
    """All cells that hold a position within the radius of this one, as an array of numbers."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    own = F.floor(lat / F.lit(_band_degrees(radius_m)))
    cells = []
    for d in (-1, 0, 1):
        band = own + d
        steps = _steps(band, radius_m)
        cells += [band * F.lit(1 << 32) + F.pmod(_step(lon, steps) + e, steps) for e in (-1, 0, 1)]
    return F.when(_valid(lat, lon), F.array_distinct(F.array(*(c.cast("long") for c in cells))))


def _places(places: DataFrame, radius_m: float, lat: str, lon: str, keep=()) -> DataFrame:
    """The places' cells and coordinates, once per cell; places without a valid position are left out."""
    rows = places.select(F.col(lat).cast("double").alias("_p_lat"), F.col(lon).cast("double").alias("_p_lon"), *(F.col(c).alias(f"_p_{c}") for c in keep))
    return rows.withColumn(CELL, F.explode(cells_around("_p_lat", "_p_lon", radius_m)))


def _within(radius_m: float, lat: str, lon: str) -> Column:
    return distance_m(lat, lon, "_p_lat", "_p_lon") <= F.lit(float(radius_m))


def near(rows: DataFrame, places: DataFrame, radius_m: float, *, lat="latitude", lon="longitude", place_lat="stop_lat", place_lon="stop_lon", away: bool = False) -> DataFrame:
    """The rows within ``radius_m`` of any place, or with ``away`` all others (rows without a position among them)."""
    celled = rows.withColumn(CELL, cell_of(F.col(lat).cast("double"), F.col(lon).cast("double"), radius_m))
    found = _places(places, radius_m, place_lat, place_lon).alias("p")
    on = (celled[CELL] == F.col(f"p.{CELL}")) & _within(radius_m, lat, lon)
    return celled.join(found, on, "left_anti" if away else "left_semi").select(*rows.columns)


def near_counts(rows: DataFrame, places: DataFrame, radius_m: float, keys, *, lat="latitude", lon="longitude", place_lat="stop_lat", place_lon="stop_lon") -> DataFrame:
    """For each row that is near any place, by its key columns: ``places`` in reach and the distance of the ``nearest``."""
    celled = rows.select(*keys, lat, lon).withColumn(CELL, cell_of(F.col(lat).cast("double"), F.col(lon).cast("double"), radius_m))
    pairs = celled.join(_places(places, radius_m, place_lat, place_lon), CELL).withColumn("_d", distance_m(lat, lon, "_p_lat", "_p_lon"))
    return pairs.filter(F.col("_d") <= float(radius_m)).groupBy(*keys).agg(F.count(F.lit(1)).alias("places"), F.min("_d").alias("nearest"))


def inside_bounds(rows: DataFrame, places: DataFrame, *, lat="latitude", lon="longitude", place_lat="stop_lat", place_lon="stop_lon", outside: bool = False) -> DataFrame:
    """Rows whose position is inside the bounds of all places, or with ``outside`` those that are not (or have none).

    The bounds are scalar subqueries: one row that Spark takes first and then compares with in the scan's filters.
    """
    one = places.agg(*(f(F.col(c).cast("double")).alias(n) for n, f, c in (("a0", F.min, place_lat), ("a1", F.max, place_lat), ("o0", F.min, place_lon), ("o1", F.max, place_lon))))
    low_lat, high_lat, low_lon, high_lon = (one.select(c).scalar() for c in ("a0", "a1", "o0", "o1"))
    inside = (F.col(lat) >= low_lat) & (F.col(lat) <= high_lat) & (F.col(lon) >= low_lon) & (F.col(lon) <= high_lon)
    return rows.filter(~F.coalesce(inside, F.lit(False)) if outside else inside)
