"""Sets of doc_ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ids_union(*frames: DataFrame) -> DataFrame:
    first, *rest = [f.select("doc_id") for f in frames]
    for f in rest:
        first = first.union(f)
    return first.distinct()


def ids_except(frame: DataFrame, removed: DataFrame) -> DataFrame:
    return frame.select("doc_id").distinct().join(removed.select("doc_id"), "doc_id", "left_anti")


def ids_intersect(frame: DataFrame, other: DataFrame) -> DataFrame:
    return frame.select("doc_id").distinct().join(other.select("doc_id"), "doc_id", "left_semi")


def only(frame: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows whose doc_id is allowed; Spark broadcasts a small list by its size and shuffles a large one."""
    return frame if allowed is None else frame.join(allowed.select("doc_id"), "doc_id", "left_semi")


def without(frame: DataFrame, removed: DataFrame | None) -> DataFrame:
    return frame if removed is None else frame.join(removed.select("doc_id"), "doc_id", "left_anti")


def ordered(frame: DataFrame, descending: bool = False) -> DataFrame:
    return frame.orderBy(F.col("doc_id").desc() if descending else F.col("doc_id").asc())
