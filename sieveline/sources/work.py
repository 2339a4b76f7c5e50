"""The folder that the driver and all executors share, for indexes that a query builds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset, on one machine, a temporary one."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="sieveline-")
    return f"{given.rstrip('/')}/sieveline/{name}-{uuid.uuid4().hex}"
