"""Distances and planar projections as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii in metres: of stop search and vehicle distances, and of line geometry.
RADIUS, GEOMETRY_RADIUS = 6_371_000.0, 6_371_008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * radius)


def leg_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whole metres of a leg; legs are rounded before they are summed, so that sums are exact."""
    return F.round(haversine(lat1, lon1, lat2, lon2)).cast("bigint")


def clamp01(x: Column) -> Column:
    """Null stays null; the least and greatest of Spark would pass over it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def plane_scale(lat: Column) -> Column:
    """Degrees of latitude to a degree of longitude. Pairs of points and segments take it as a column of the point."""
    return F.cos(F.radians(lat))


def fraction_along(lat: Column, lon: Column, scale: Column, lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Where the foot of a point lies on a segment, 0 to 1, in a plane scaled by ``scale``; 0 on one without length."""
    dx, dy = (lon1 - lon0) * scale, lat1 - lat0
    length2 = dx * dx + dy * dy
    along = ((lon - lon0) * scale * dx + (lat - lat0) * dy) / F.nullif(length2, F.lit(0.0))
    return F.when(along > 1, F.lit(1.0)).when(along > 0, along).when((along <= 0) | (length2 == 0), F.lit(0.0))


def squared_offset(lat: Column, lon: Column, scale: Column, lat_on: Column, lon_on: Column) -> Column:
    dx, dy = (lon - lon_on) * scale, lat - lat_on
    return dx * dx + dy * dy


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def in_box(lat: Column, lon: Column, corner1: tuple[float, float], corner2: tuple[float, float]) -> Column:
    """Inclusive test against a box of two (lat, lon) corners in any order; no wrap at the antimeridian."""
    lats, lons = sorted((corner1[0], corner2[0])), sorted((corner1[1], corner2[1]))
    if lats[0] == lats[1] or lons[0] == lons[1]:
        raise ValueError("the box has no area")
    return F.coalesce(lat.between(*lats) & lon.between(*lons) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))
