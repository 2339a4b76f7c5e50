"""Exact keys: entries (doc_id, key), compared by bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_filter(entries: DataFrame, key: str) -> DataFrame:
    return entries.where(F.col("key") == key).select("doc_id").distinct()


def key_enumerate(entries: DataFrame) -> DataFrame:
    """All keys that have a document, once each, in byte order."""
    return entries.where("key is not null").select("key").distinct().orderBy("key")
