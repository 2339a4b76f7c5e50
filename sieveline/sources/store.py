"""Versions of a field on any Hadoop file system.

    <root>/current/<version>       the format version; the greatest version there is the current one
    <root>/ops/seq=<n>/            one batch of the operation log, which counts once its _SUCCESS is there
    <root>/segments/<name>/        entries with their seq
    <root>/lengths/<name>/         of a text segment: (doc_id, field_length, seq), a row for each document
    <root>/terms/<name>/           of a text segment: (term, postings), a row for each distinct term
    <root>/versions/<v>.json       manifest: segments, tombstones, the last seq that it covers
    <root>/streamed/<id>-<seq>     seqs reserved for a micro-batch of a stream

Nothing is replaced: a pointer is a new file for each version, so that a reader at any moment finds a whole one, also where
a rename doesn't replace.
    <root>/tombstones/<name>/      (doc_id, seq)
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Format 1 had a file CURRENT with its number and the version, and text segments without lengths and terms. It is read; the
#: next compaction rewrites such segments and points by the present form.
FORMAT = 2
EMPTY = {"version": 0, "segments": [], "tombstones": None, "covers": 0}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, which the optimizer sees; those of ``createDataFrame`` come from Python workers."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(*parts))) if self.exists(*parts) else []

    def bytes(self, *parts: str) -> int:
        return self.fs.getContentSummary(self.path(*parts)).getLength() if self.exists(*parts) else 0

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        """A new file, whole or not at all: written beside, then renamed. A file that a failed attempt left gives way."""
        temporary, final = self.path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}"), self.path(*parts)
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(temporary, final):
            if self.exists(*parts) and self.read(*parts) == text:
                self.fs.delete(temporary, False)
                return
            self.fs.delete(final, False)
            if not self.fs.rename(temporary, final):
                raise OSError(f"could not write {final}")

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)

    def pointers(self) -> list[str]:
        return [n for n in self.names("current") if n.isdigit()]

    def current(self) -> int:
        """The current version; 0 before the first."""
        found = self.pointers()
        if not found:
            if not self.exists("CURRENT"):
                return 0
            form, version = self.read("CURRENT").split()
            if form != "1":
                raise ValueError(f"format version {form} is not {FORMAT}")
            return int(version)
        form = self.read("current", found[-1]).strip()
        if form != str(FORMAT):
            raise ValueError(f"format version {form} is not {FORMAT}")
        return int(found[-1])

    def point(self, version: int) -> None:
        self.write(f"{FORMAT}\n", "current", f"{version:020d}")

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        return json.loads(self.read("versions", f"{version}.json")) if version else dict(EMPTY)

    def save_manifest(self, manifest: dict) -> None:
        self.write(json.dumps(manifest), "versions", f"{manifest['version']}.json")

    def table(self, schema: T.StructType, *paths: str) -> DataFrame:
        if not paths:
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def save(self, df: DataFrame, kind: str, sort: list[str], partitions: int | None = None, in_place: bool = False) -> str:
        """Written clustered by ``sort``, so that row groups can be skipped; returns the path below the root. ``in_place``: each
        task sorts the rows that it reads and nothing is exchanged; pages are then skipped in every file."""
        name = f"{kind}/{uuid.uuid4().hex}"
        # Rows that are equal in ``sort`` are told apart by doc_id, so that a frequent value is spread over files.
        dealt = df.repartitionByRange(*([partitions] if partitions else []), *sort) if sort and not in_place else df
        dealt = dealt.sortWithinPartitions(*sort) if sort else dealt
        dealt.write.parquet(f"{self.root}/{name}")
        return name
