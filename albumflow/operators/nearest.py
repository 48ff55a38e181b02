"""Nearest places of coordinates, and places by name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumflow.functions.numbers import EARTH_KM, bearing, haversine_km

KM_A_DEGREE = EARTH_KM * math.pi / 180


#: Cells halve from the limit down to about so many km.
LEAST_KM = 2.0


def _cells(band: Column, width: Column) -> Column:
    """Into how many cells of longitude a band falls: each at least as wide as the reach at the band's far end."""
    far = F.greatest(F.abs(band * width), F.abs((band + 1) * width))
    open_ = far + width < 90
    spread = F.degrees(F.asin(F.least(F.sin(F.radians(width)) / F.cos(F.radians(F.when(open_, far))), F.lit(1.0))))
    return F.when(open_, F.greatest(F.floor(360 / spread), F.lit(1))).otherwise(1)


def _cell(lon: Column, cells: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * cells), cells - 1)


def _width(max_km: float, level: Column) -> Column:
    """Degrees of latitude of a level's bands: a little more than its reach, ``max_km`` halved so many times."""
    return F.greatest(F.lit(max_km / KM_A_DEGREE * 1.0001) / F.pow(F.lit(2.0), level), F.lit(1e-6))


def _at_levels(rows: DataFrame, lat: str, lon: str, max_km: float, finest: int) -> DataFrame:
    """rows once for each level, with their band and cell there."""
    out = rows.withColumn("level", F.explode(F.lit(list(range(finest + 1))))).withColumn("width", _width(max_km, F.col("level")))
    out = out.withColumn("band", F.floor(F.col(lat) / F.col("width")))
    return out.withColumn("cell", _cell(F.col(lon), _cells(F.col("band"), F.col("width")))).drop("width")


def _reaches(spots: DataFrame, index: DataFrame, place_id: str, max_km: float, k: int, finest: int) -> DataFrame:
    """lat, lon, reach of every spot: its k nearest places within ``max_km`` are not farther than that.

    Any k places will do as a bound: those with the smallest ids of the spot's own cell, at each level where it has so many.
    """
    by_id = F.row_number().over(Window.partitionBy("level", "band", "cell").orderBy(place_id))
    some = index.withColumn("number", by_id).where(F.col("number") <= k).groupBy("level", "band", "cell").agg(F.collect_list(F.struct("lat2", "lon2")).alias("some")).where(F.size("some") == k)
    farthest = F.array_max(F.transform("some", lambda x: haversine_km(F.col("lat"), F.col("lon"), x["lat2"], x["lon2"])))
    met = _at_levels(spots, "lat", "lon", max_km, finest).join(some, ["level", "band", "cell"], "left")
    bound = F.min(farthest) * (1 + 1e-9) + 1e-6  # a sine may differ in its last bit between runs of one expression
    return met.groupBy("lat", "lon").agg(F.least(F.coalesce(bound, F.lit(max_km)), F.lit(max_km)).alias("reach"))


def nearest(
    points: DataFrame, places: DataFrame, point_id: str, place_id: str, max_km: float, k: int = 1,
    min_population: int | None = None, features: list[str] | None = None,
) -> DataFrame:
    """point_id, place_id, km, bearing, rank of the ``k`` places nearest to each point, within ``max_km``.

    Points and places have lat and lon; of places only those with at least ``min_population`` and one of
    the ``features`` (column feature_code) count.  Points of one spot are one, and of places at one spot the first ``k`` count.  There
    are levels of bands of latitude and cells of longitude, as wide as the limit or a half, a quarter... of it.  Where a point has
    many places around, some of them tell how far its nearest can be, and it is compared with the cells around it of the level of that
    reach; so dense tables do not make pairs of all within the limit.  No pair in reach is missed, across poles and date line.
    """
    if min_population is not None:
        places = places.where(F.col("population") >= min_population)
    if features:
        places = places.where(F.col("feature_code").isin(*features))
    finest = max(0, math.ceil(math.log2(max_km / LEAST_KM))) if max_km > 0 else 0
    # Spark keeps the k best of each task before the shuffles of these windows
    at_spot = F.row_number().over(Window.partitionBy("lat2", "lon2").orderBy(place_id))
    own = places.select(place_id, F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).withColumn("number", at_spot).where(F.col("number") <= k).drop("number")
    index = _at_levels(own, "lat2", "lon2", max_km, finest)
    spots = _reaches(points.select("lat", "lon").distinct(), index, place_id, max_km, k, finest)
    level = F.floor(F.log2(F.lit(max_km) / F.greatest("reach", F.lit(max_km / 2**finest)))).cast("int") if finest else F.lit(0)
    here = spots.withColumn("level", level).withColumn("width", _width(max_km, F.col("level")))
    band = F.floor(F.col("lat") / F.col("width"))
    here = here.withColumn("band", F.explode(F.sequence(band - 1, band + 1))).withColumn("cells", _cells(F.col("band"), F.col("width")))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(_cell(F.col("lon"), F.col("cells")) + i, F.col("cells"))))
    here = here.select("lat", "lon", "reach", "level", "band", F.explode(around).alias("cell"))
    pairs = here.join(index, ["level", "band", "cell"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where("km <= reach")
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("km", place_id))
    found = pairs.withColumn("number", first).where(F.col("number") <= k)
    found = found.select("lat", "lon", place_id, "km", bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("bearing"))
    rank = F.row_number().over(Window.partitionBy(point_id).orderBy("km", place_id))
    out = points.select(point_id, "lat", "lon").join(found, ["lat", "lon"]).select(point_id, place_id, "km", "bearing")
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


MOST_PLACES = 200


def places_named(
    places: DataFrame, city: str | None = None, country: str | None = None, pattern: str | None = None, min_population: int = 0,
    region: str | None = None, patterns: dict[str, str] | None = None, features: list[str] | None = None, most: int | None = None,
) -> DataFrame:
    """Places by exact names or patterns, letter case aside, largest first.

    ``patterns`` maps columns (city, region, country, country_code, ...) to regular expressions; one that begins
    with ``!`` must not match.  More than ``most`` hits are an error (``MOST_PLACES`` is a usual limit).
    """
    rows = places.where(F.col("population") >= min_population)
    if city is not None:
        rows = rows.where(F.lower("city") == city.lower())
    if country is not None:
        rows = rows.where((F.lower("country") == country.lower()) | (F.lower("country_code") == country.lower()))
    if region is not None:
        rows = rows.where(F.lower("region") == region.lower())
    for column, own in ({"city": pattern} if pattern is not None else {}).items() | (patterns or {}).items():
        hit = F.coalesce(F.col(column), F.lit("")).rlike(f"(?i){own.removeprefix('!')}")
        rows = rows.where(~hit if own.startswith("!") else hit)
    if features:
        rows = rows.where(F.col("feature_code").isin(*features))
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} places match")
    return rows.orderBy(F.desc("population"), "city")
