"""Geometry on latitude and longitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0
LAT_SCALE, LON_SCALE = (2**31 - 1) / 180.0, (2**31 - 1) / 360.0


def in_range(lat: Column, lon: Column) -> Column:
    """Whether a point may be indexed; not a number never is."""
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon)


def encode_lat(lat: Column) -> Column:
    return F.round(lat * LAT_SCALE).cast("int")


def encode_lon(lon: Column) -> Column:
    return F.round(lon * LON_SCALE).cast("int")


def decode_lat(code: Column) -> Column:
    return code / F.lit(LAT_SCALE)


def decode_lon(code: Column) -> Column:
    return code / F.lit(LON_SCALE)


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres between each point and a fixed one."""
    half_lat, half_lon = F.radians(lat - F.lit(lat0)) / 2, F.radians(lon - F.lit(lon0)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_METRES) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def radius_box(lat: float, lon: float, metres: float) -> tuple[float, float, float, float]:
    """(min lat, max lat, min lon, max lon) of a box around a circle; all longitudes near a pole or the date line."""
    angle = metres / EARTH_METRES
    south, north = lat - math.degrees(angle), lat + math.degrees(angle)
    if south <= -90 or north >= 90 or angle >= math.pi / 2:
        return max(south, -90.0), min(north, 90.0), -180.0, 180.0
    wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    if lon - wide < -180 or lon + wide > 180:
        return south, north, -180.0, 180.0
    return south, north, lon - wide, lon + wide


def in_box(lat: Column, lon: Column, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Inclusive on all sides; a box with min_lon > max_lon is empty and does not wrap."""
    return lat.between(float(min_lat), float(max_lat)) & lon.between(float(min_lon), float(max_lon))


def in_polygon(lat: Column, lon: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray casting over (lat, lon) vertices, in planar degrees, half-open on latitude. The edges are literals, so that the
    whole test is one generated expression; edges along a parallel never toggle and are left out."""
    if len(vertices) < 3:
        raise ValueError("a polygon has at least three vertices")
    crossings = F.lit(0)
    for (yi, xi), (yj, xj) in zip(vertices, [vertices[-1], *vertices[:-1]], strict=True):
        if yi == yj:
            continue
        spans = (F.lit(float(yi)) > lat) != (F.lit(float(yj)) > lat)
        edge = F.lit(float(xj - xi)) * (lat - F.lit(float(yi))) / F.lit(float(yj - yi)) + F.lit(float(xi))
        crossings = crossings + (spans & (lon < edge)).cast("int")
    return crossings % 2 == 1


def polygon_box(vertices: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    lats, lons = [v[0] for v in vertices], [v[1] for v in vertices]
    return min(lats), max(lats), min(lons), max(lons)
