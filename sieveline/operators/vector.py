"""Exact nearest neighbours: entries (doc_id, ord, vec), one row for each vector of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.vectors import distance
from sieveline.operators.ids import only


def knn(entries: DataFrame, query: list[float], k: int, metric: str = "l2", allowed: DataFrame | None = None, dim: int | None = None, per_document: int | None = None) -> DataFrame:
    """(doc_id, distance) of the k nearest documents by their nearest vector, ties by doc_id. The filter comes before the cut.

    Of the k * m nearest vectors, m being the most vectors that a document has (``per_document``; by default the greatest
    ``ord``), the first k documents are exact. Each task keeps that many vectors of its own, and nothing else is exchanged.
    """
    if dim is not None and len(query) != dim:
        raise ValueError(f"the query has {len(query)} dimensions, the index {dim}")
    if k <= 0:
        return entries.select("doc_id", F.lit(0.0).alias("distance")).where(F.lit(False))
    most = per_document or 1 + (entries.agg(F.max("ord")).first()[0] or 0)
    rows = only(entries, allowed).select("doc_id", distance(metric, F.col("vec"), query).alias("distance")).where("distance is not null")
    nearest = rows.orderBy("distance", "doc_id").limit(k * most)
    return nearest.groupBy("doc_id").agg(F.min("distance").alias("distance")).orderBy("distance", "doc_id").limit(k)


def calibration(entries: DataFrame) -> DataFrame:
    """(pos, low, high): bounds of every dimension."""
    return entries.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
