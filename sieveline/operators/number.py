"""Number fields: entries (doc_id, value). Doubles are in total order: -0.0 lies below 0.0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("eq", "gt", "gte", "lt", "lte", "between")


def _is_zero(value: Column) -> Column:
    # No equality: the optimiser would put the literal, which has no sign, in place of the column elsewhere.
    return (value >= 0) & (value <= 0)


def is_negative_zero(value: Column) -> Column:
    return _is_zero(value) & (value.cast("string") == "-0.0")


def _compare(op: str, value: Column, bound, is_double: bool) -> Column:
    plain = {"eq": value == bound, "gt": value > bound, "gte": value >= bound, "lt": value < bound, "lte": value <= bound}[op]
    if not (is_double and bound == 0):
        return plain
    zero, below = _is_zero(value), is_negative_zero(value)
    if math.copysign(1.0, bound) < 0:  # the bound is -0.0
        return {"eq": below, "gt": plain | (zero & ~below), "gte": plain, "lt": plain, "lte": (value < 0) | below}[op]
    return {"eq": zero & ~below, "gt": plain, "gte": (value > 0) | (zero & ~below), "lt": plain | below, "lte": plain}[op]


def predicate(op: str, *bounds, column: str = "value", is_double: bool = False) -> Column:
    """A condition that reaches the scan: plain comparisons with literals."""
    value = F.col(column)
    if op not in OPERATORS or len(bounds) != (2 if op == "between" else 1):
        raise ValueError(f"op is one of {OPERATORS}, with one bound, between with two")
    if any(isinstance(b, float) and math.isnan(b) for b in bounds):
        raise ValueError("a bound is not a number")
    if op == "between":
        return _compare("gte", value, bounds[0], is_double) & _compare("lte", value, bounds[1], is_double)
    return _compare(op, value, bounds[0], is_double)


def number_filter(entries: DataFrame, op: str, *bounds) -> DataFrame:
    """(doc_id, value), distinct: a document with an array of values may come several times."""
    is_double = dict(entries.dtypes)["value"] in ("double", "float")
    return entries.where(predicate(op, *bounds, is_double=is_double)).select("doc_id", "value").distinct()


def _total_order(descending: bool) -> list[Column]:
    # -0.0 sorts as its own value between the negative numbers and 0.0.
    zero = is_negative_zero(F.col("value"))
    return [F.col("value").desc(), zero.asc()] if descending else [F.col("value").asc(), zero.desc()]


def sort_order(entries: DataFrame, descending: bool = False) -> list[Column]:
    """By value, then doc_id, both descending if so."""
    is_double = dict(entries.dtypes)["value"] in ("double", "float")
    order = _total_order(descending) if is_double else [F.col("value").desc() if descending else F.col("value").asc()]
    return [*order, F.col("doc_id").desc() if descending else F.col("doc_id").asc()]


def number_sort(entries: DataFrame, descending: bool = False) -> DataFrame:
    """(doc_id, value) by value, then doc_id, both descending if so; repeats stay."""
    return entries.where("value is not null").select("doc_id", "value").orderBy(*sort_order(entries, descending))


def number_sort_grouped(entries: DataFrame, descending: bool = False) -> DataFrame:
    """(value, doc_ids): one row for each value; ids ascending, or descending with the values.

    A row holds all ids of a value, so that a very frequent value needs a task that can hold them; ``number_sort`` is the
    same order in long form, without that need.
    """
    rows = entries.where("value is not null")
    is_double = dict(entries.dtypes)["value"] in ("double", "float")
    groups = rows.withColumn("z", is_negative_zero(F.col("value")) if is_double else F.lit(False)).groupBy("value", "z").agg(F.collect_set("doc_id").alias("ids"))
    groups = groups.select("value", "z", F.sort_array("ids", asc=not descending).alias("doc_ids"))
    order = [F.col("value").desc(), F.col("z").asc()] if descending else [F.col("value").asc(), F.col("z").desc()]
    restored = F.when(F.col("z"), F.lit(-0.0)).otherwise(F.col("value")) if is_double else F.col("value")
    return groups.orderBy(*order).select(restored.alias("value"), "doc_ids")
