"""Distances and boxes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
EARTH_KM, PAD_DEGREES, RADIUS_RANGE, RADIUS_ELSE = 6371.0088, 0.02, (400, 6000), 1500


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres to three digits; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.bround(2 * EARTH_KM * F.asin(F.sqrt(a)), 3)


def in_box(lat: Column, lon: Column, box: Column, pad: float = PAD_DEGREES) -> Column:
    """Whether a point lies in struct(lat_min, lon_min, lat_max, lon_max); true where there is no box or no point to judge by."""
    inside = lat.between(box["lat_min"] - pad, box["lat_max"] + pad) & lon.between(box["lon_min"] - pad, box["lon_max"] + pad)
    return F.coalesce(F.when(lat.isNotNull(), inside), F.lit(True))


def radius_m(area: Column) -> Column:
    """The radius of a circle of an area, clamped; a default where there is none."""
    r = F.when(F.coalesce(area, F.lit(0.0)) != 0, F.floor(F.sqrt(F.abs(area) / F.pi()))).otherwise(RADIUS_ELSE)
    return F.greatest(F.lit(RADIUS_RANGE[0]), F.least(r, F.lit(RADIUS_RANGE[1]))).cast("int")


def midpoint(points: Column) -> Column:
    """struct(lat, lon) of the middle vertex of an array of [lon, lat] pairs."""
    p = F.try_element_at(points, (F.size(points) / 2).cast("int") + 1)
    return F.when(F.size(points) > 0, F.struct(F.bround(p[1], 6).alias("lat"), F.bround(p[0], 6).alias("lon")))
