"""Distances between an array column and a fixed vector, and scalar quantisation.

Short vectors are unrolled into one generated expression; long ones are folded, as a very large expression would leave the
code generator's limits.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLLED = 32


def _sum(vec: Column, query: list[float], term) -> Column:
    if len(query) <= UNROLLED:
        # A balanced sum keeps the expression shallow.
        parts = [term(F.get(vec, F.lit(i)).cast("double"), F.lit(float(q))) for i, q in enumerate(query)]
        while len(parts) > 1:
            parts = [reduce(add, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]
    both = F.zip_with(vec, F.array(*[F.lit(float(q)) for q in query]), lambda a, b: term(a.cast("double"), b))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def l2(vec: Column, query: list[float]) -> Column:
    """Squared Euclidean distance."""
    return _sum(vec, query, lambda a, b: (a - b) * (a - b))


def dot(vec: Column, query: list[float]) -> Column:
    """Negated inner product, so that less is nearer."""
    return -_sum(vec, query, lambda a, b: a * b)


def cosine(vec: Column, query: list[float]) -> Column:
    """1 less the cosine; 1 where either vector is zero."""
    size = math.sqrt(sum(q * q for q in query))
    if size == 0:
        return F.when(vec.isNotNull(), F.lit(1.0))
    unit = [q / size for q in query]
    norm = F.sqrt(_sum(vec, unit, lambda a, b: a * a))
    return F.when(norm == 0, F.lit(1.0)).otherwise(F.lit(1.0) - _sum(vec, unit, lambda a, b: a * b) / F.nullif(norm, F.lit(0.0)))


METRICS = {"l2": l2, "dot": dot, "cosine": cosine}


def distance(metric: str, vec: Column, query: list[float]) -> Column:
    return METRICS[metric](vec, query)


def usable(vec: Column, dim: int) -> Column:
    """Of the right length and all finite."""
    return (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantised(vec: Column, low: Column, high: Column) -> Column:
    """Bytes from -127 to 127 of each dimension between its calibrated bounds; a flat dimension is widened by 1."""
    bounds = F.arrays_zip(low.alias("lo"), high.alias("hi"))
    width = lambda b: F.when(b["hi"] > b["lo"], b["hi"] - b["lo"]).otherwise(b["hi"] + 1.0 - b["lo"])
    code = lambda x, b: F.least(F.greatest(F.round((x - b["lo"]) * 254.0 / width(b) - 127.0), F.lit(-127.0)), F.lit(127.0))
    return F.zip_with(vec, bounds, lambda x, b: code(x.cast("double"), b).cast("byte"))


def _codes(a: Column, b: list[int], term) -> Column:
    both = F.zip_with(a, F.array(*[F.lit(int(x)) for x in b]), lambda x, y: term(x.cast("int"), y))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


def i8_l2(codes: Column, query: list[int]) -> Column:
    """Squared Euclidean distance of byte codes, in whole numbers."""
    return _codes(codes, query, lambda a, b: (a - b) * (a - b))


def i8_dot(codes: Column, query: list[int]) -> Column:
    return -_codes(codes, query, lambda a, b: a * b)


def i8_cosine(codes: Column, query: list[int]) -> Column:
    """1 less the cosine; 1 where either vector is zero."""
    own = F.aggregate(F.transform(codes, lambda a: a.cast("int") * a.cast("int")), F.lit(0), lambda s, x: s + x)
    size = sum(x * x for x in query)
    if size == 0:
        return F.when(codes.isNotNull(), F.lit(1.0))
    product = _codes(codes, query, lambda a, b: a * b)
    return F.when(own == 0, F.lit(1.0)).otherwise(F.lit(1.0) - product / F.sqrt(F.nullif(own, F.lit(0)).cast("double") * float(size)))


I8_METRICS = {"l2": i8_l2, "dot": i8_dot, "cosine": i8_cosine}


def quantise(vector: list[float], low: list[float], high: list[float]) -> list[int]:
    """``quantised`` for one vector on the driver."""
    width = [b - a if b > a else b + 1.0 - a for a, b in zip(low, high, strict=True)]
    half_up = lambda x: math.floor(x + 0.5) if x >= 0 else -math.floor(-x + 0.5)
    return [int(min(127, max(-127, half_up((x - a) * 254.0 / w - 127.0)))) for x, a, w in zip(vector, low, width, strict=True)]
