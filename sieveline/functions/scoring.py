"""BM25F parts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K, B, EXACT_BOOST = 1.2, 0.75, 3.0


def idf(n: Column, df: Column) -> Column:
    """0 where nothing matched; negative where prefix or fuzzy matches count documents several times."""
    return F.when(df == 0, F.lit(0.0)).otherwise(F.log1p((n - df + 0.5) / (df + 0.5)))


def normalised_tf(tf: Column, length: Column, average: Column, b: float = B) -> Column:
    """Term frequency against the length of the field; an average of 0 counts as no length at all."""
    ratio = F.when(average > 0, length / F.nullif(average, F.lit(0.0))).otherwise(F.lit(0.0))
    return tf / (F.lit(1.0 - b) + F.lit(b) * ratio)


def saturated(idf_: Column, ntf: Column, k: float = K) -> Column:
    return idf_ * F.lit(k + 1.0) * ntf / (F.lit(k) + ntf)


def phrase_multiplier(adjacent: Column, boost: float) -> Column:
    return F.lit(1.0) + adjacent * F.lit(float(boost))
