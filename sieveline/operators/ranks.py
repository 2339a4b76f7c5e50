"""The place of each row in a total order, without bringing the rows to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL = (1 << 33) - 1


def _checkpoint_folder(df: DataFrame) -> None:
    """Use spark.checkpoint.dir; only where it is unset, on one machine, make a folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    given = context.getConf().get("spark.checkpoint.dir")
    if not given and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="sieveline-"))


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with the number of each row, from 1, in ``order`` (which should leave no ties).

    Spark sorts by ranges; the sorted rows are checkpointed with their place in their range, and the sizes of the ranges
    before, one row for each range, are added.
    """
    _checkpoint_folder(df)
    columns = df.columns
    placed = df.orderBy(*order).select(F.struct(*columns).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)).alias("at")).checkpoint()
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")  # one row for each task of the sort
    return ranked.select("row.*", (F.col("before") + F.col("at") + 1).alias(name))
