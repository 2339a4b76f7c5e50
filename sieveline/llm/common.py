"""Helpers shared by the corpus operators: input tables, shared work folders, bounded caches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to Python. Texts can be long, so batches are kept short.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the path may be one that no other reader can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Give this package's source to the Python workers, once for each application: they may start where it isn't installed."""
    top, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _SHIPPED or not top.is_dir():  # a package in an archive has come by --py-files
        return
    archive = Path(tempfile.mkdtemp(prefix="sieveline-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Before any Python on the executors: short Arrow batches, and the package on the workers."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where that is unset (local tests, one machine) a temporary folder is made and kept in the session's conf.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("sieveline.work.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("sieveline.work.dir", given)
    return given.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sieveline/{name}-{uuid.uuid4().hex}"


#: What ``written`` made within each open ``scratch``: tables and their folders.
_OPEN: list[list[tuple[DataFrame, str]]] = []


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage ends there, and a lost executor
    costs no recomputation. Unlike a checkpoint the table keeps column pruning and exact size statistics."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1].append((stored, path))
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Deletes at its end the tables that ``written`` made within, but those handed to the function that it gives: what a
    result is still to be read from."""
    made: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield lambda *frames: kept.extend(frames)
    finally:
        _OPEN.pop()
        for df, path in made:
            if not any(df is k for k in kept):
                _delete(spark, path)
            elif _OPEN:
                _OPEN[-1].append((df, path))


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` once what was derived from them is itself written."""
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/sieveline/" in path:
                _delete(df.sparkSession, path)


class TwoGenerations(dict):
    """A memo of at most ``3 * half`` entries: ``memo[key]`` computes what is missing.

    When the young generation is full it becomes the old one, and what is still in use moves back; frequent keys
    therefore stay, and memory is bounded whatever the corpus.
    """

    def __init__(self, compute: Callable, half: int) -> None:
        super().__init__()
        self.compute, self.half, self.old = compute, half, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def put_all(self, keys: list, values: list) -> None:
        for start in range(0, len(keys), self.half):
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self.update(zip(keys[start : start + self.half], values[start : start + self.half], strict=True))


def rows_of(batches: Iterator, *columns: str) -> Iterator[list[list]]:
    """For each Arrow batch, the columns as Python lists."""
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
