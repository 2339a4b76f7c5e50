"""Points: entries (doc_id, lat, lon). A document may come once for each of its points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import geo as G


def _filter(entries: DataFrame, condition) -> DataFrame:
    return entries.where(condition).select("doc_id")


def geo_box(entries: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float, outside: bool = False) -> DataFrame:
    inside = G.in_box(F.col("lat"), F.col("lon"), min_lat, max_lat, min_lon, max_lon)
    return _filter(entries, ~inside if outside else inside)


def geo_radius(entries: DataFrame, lat: float, lon: float, metres: float, outside: bool = False) -> DataFrame:
    """Within or beyond a distance. A surrounding box is added inside, so that the scan can skip row groups."""
    away = G.haversine(F.col("lat"), F.col("lon"), lat, lon)
    if outside:
        return _filter(entries, away > metres)
    south, north, west, east = G.radius_box(lat, lon, metres)
    slack = 1e-9
    return _filter(entries, G.in_box(F.col("lat"), F.col("lon"), south - slack, north + slack, west - slack, east + slack) & (away <= metres))


def geo_polygon(entries: DataFrame, vertices: list[tuple[float, float]], outside: bool = False) -> DataFrame:
    inside = G.in_polygon(F.col("lat"), F.col("lon"), vertices)
    return _filter(entries, ~inside) if outside else _filter(entries, G.in_box(F.col("lat"), F.col("lon"), *G.polygon_box(vertices)) & inside)


def geo_box_quantised(entries: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float, outside: bool = False) -> DataFrame:
    """The box compared on 32-bit codes, as points are stored."""
    bound = lambda x, scale: int(abs(x) * scale + 0.5) * (1 if x >= 0 else -1)
    lat, lon = G.encode_lat(F.col("lat")), G.encode_lon(F.col("lon"))
    inside = lat.between(bound(min_lat, G.LAT_SCALE), bound(max_lat, G.LAT_SCALE)) & lon.between(bound(min_lon, G.LON_SCALE), bound(max_lon, G.LON_SCALE))
    return _filter(entries, ~inside if outside else inside)


def as_stored(entries: DataFrame) -> DataFrame:
    """Entries whose points are what their 32-bit codes decode to: with these, a radius or polygon is judged as on codes."""
    return entries.withColumns({"lat": G.decode_lat(G.encode_lat(F.col("lat"))), "lon": G.decode_lon(G.encode_lon(F.col("lon")))})
