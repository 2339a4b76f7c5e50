"""Boolean fields: entries (doc_id, value). A document with an array may hold both values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_order(descending: bool = False) -> list[Column]:
    """False before true, doc_ids ascending in each; all reversed if descending."""
    return [F.col("value").desc(), F.col("doc_id").desc()] if descending else [F.col("value").asc(), F.col("doc_id").asc()]


def bool_filter(entries: DataFrame, value: bool, order: str | None = None) -> DataFrame:
    """Distinct doc_ids; ``order`` is asc, desc or None."""
    found = entries.where(F.col("value") == value).select("doc_id").distinct()
    return found if order is None else found.orderBy(F.col("doc_id").desc() if order == "desc" else F.col("doc_id").asc())


def bool_sort(entries: DataFrame, descending: bool = False) -> DataFrame:
    """(doc_id, value), distinct, in ``sort_order``."""
    rows = entries.where("value is not null").select("doc_id", "value").distinct()
    return rows.orderBy(*sort_order(descending))
