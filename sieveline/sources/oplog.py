"""The operation log: rows (seq, op, doc_id, entry columns), op being insert or delete.

A delete hides every entry of its document with a smaller seq. Fields that gather keep the set of what is left; text and
vector fields keep the entries of the last insert only. The order of rows does not matter, only seq does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.schema import REPLACING, FieldSpec


def live_view(ops: DataFrame, spec: FieldSpec) -> DataFrame:
    """(doc_id, entry columns, seq) of what is visible. One exchange on doc_id: the last delete, and for replacing fields the
    last insert, are found by a partial aggregate and joined back; a document with very many operations is split by Spark."""
    columns = spec.entries.fieldNames()
    last = ops.groupBy("doc_id").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("deleted"), F.max(F.when(F.col("op") == "insert", F.col("seq"))).alias("inserted"))
    rows = ops.where("op = 'insert'").join(last, "doc_id").where("deleted is null or seq > deleted")
    if spec.kind in REPLACING:
        return rows.where("seq = inserted").select("doc_id", *columns, "seq")
    return rows.groupBy("doc_id", *columns).agg(F.max("seq").alias("seq")) if spec.kind != "geo" else rows.select("doc_id", *columns, "seq")


def hidden(ops: DataFrame, spec: FieldSpec) -> DataFrame:
    """(doc_id, seq): entries of the document with a smaller seq are hidden by these operations."""
    rows = ops if spec.kind in REPLACING else ops.where("op = 'delete'")
    return rows.groupBy("doc_id").agg(F.max("seq").alias("seq"))


def visible(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries (doc_id, ..., seq) that no tombstone (doc_id, seq) of a greater seq hides."""
    t = tombstones.select("doc_id", F.col("seq").alias("hidden_before"))
    return entries.join(t, "doc_id", "left").where("hidden_before is null or seq >= hidden_before").drop("hidden_before")
