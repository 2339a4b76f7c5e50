"""Token-id files with shuffled planes.

A shard holds the ids of documents in ascending order. Ids are cut into blocks of a fixed size; a block is transposed into
byte planes (the lowest bytes of all ids, then the next, ...) or bit planes, and each plane is compressed with zstandard:
the planes of high bits are nearly constant and vanish. Layout::

    b"SVTOK1\\n" + kind ("B" or "b") | planes of block 0 | planes of block 1 | ... | footer | size of footer, u32 | b"SVTOKEND"

The footer is zstandard over a JSON head and the index: ids and plane sizes of each block, then document ids and lengths.
A reader opens the footer and then only the blocks that it wants.

A task writes its shard under a name that only its attempt has, and nothing is renamed. The manifest is a Spark table, of
which one attempt of each task is committed, so that it names one whole file for each shard however often tasks were run;
files of other attempts are never read. Shards lie in the folder that the cluster shares, through any file system that
pyarrow knows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm import wordbpe
from sieveline.llm.common import new_folder, rows_of, scratch, short_batches, table, text_or_empty, written

MAGIC, CLOSE = b"SVTOK1\n", b"SVTOKEND"
BLOCK = 1 << 16
LEVEL = 1


def shuffle_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte planes ("B", lowest first) or bit planes ("b", lowest first) of unsigned 32-bit ids."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "B":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "B":
        octets = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard to a binary stream; memory is one block and two integers for each document."""

    def __init__(self, stream, kind: str = "B", block: int = BLOCK, level: int = LEVEL) -> None:
        import zstandard

        if kind not in ("B", "b"):
            raise ValueError("kind is B (byte planes) or b (bit planes)")
        self.stream, self.kind, self.block = stream, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting, self.index, self.keys, self.lengths = bytearray(), [], [], []
        stream.write(MAGIC + kind.encode())

    def add(self, key: int | None, ids: bytes) -> None:
        """A document's ids as little-endian unsigned 32-bit integers."""
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.waiting += ids
        while len(self.waiting) >= 4 * self.block:
            self._flush(4 * self.block)

    def _flush(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.waiting[:size]), "<u4")
        del self.waiting[:size]
        planes = [self.zip.compress(p) for p in shuffle_planes(ids, self.kind)]
        self.index.append([len(ids), *map(len, planes)])
        for p in planes:
            self.stream.write(p)

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        if self.waiting:
            self._flush(len(self.waiting))
        footer = self.zip.compress(json.dumps({"kind": self.kind, "block": self.block, "blocks": self.index, "keys": self.keys, "lengths": self.lengths}).encode())
        self.stream.write(footer + len(footer).to_bytes(4, "little") + CLOSE)
        return len(self.keys), sum(self.lengths)


class ShardReader:
    """Reads a shard from a seekable stream of ``size`` bytes."""

    def __init__(self, stream, size: int) -> None:
        import zstandard

        self.stream, self.unzip = stream, zstandard.ZstdDecompressor()
        stream.seek(size - 12)
        tail = stream.read(12)
        if tail[4:] != CLOSE:
            raise ValueError("not a whole shard")
        n = int.from_bytes(tail[:4], "little")
        stream.seek(size - 12 - n)
        self.head = json.loads(self.unzip.decompress(stream.read(n)))
        self.starts, at = [], len(MAGIC) + 1
        for _, *sizes in self.head["blocks"]:
            self.starts.append(at)
            at += sum(sizes)

    def read_block(self, k: int) -> np.ndarray:
        n, *sizes = self.head["blocks"][k]
        self.stream.seek(self.starts[k])
        data, planes, at = self.stream.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unzip.decompress(data[at : at + s]))
            at += s
        return join_planes(planes, n, self.head["kind"])

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(key, start within the shard, parts of its ids), block by block."""
        block, held, at, start = 0, np.zeros(0, "<u4"), 0, 0
        for key, n in zip(self.head["keys"], self.head["lengths"], strict=True):
            parts, missing = [], n
            while missing:
                if at == len(held):
                    held, at, block = self.read_block(block), 0, block + 1
                part = held[at : at + missing]
                parts.append(part)
                at, missing = at + len(part), missing - len(part)
            yield key, start, parts
            start += n


def write_shards(docs: DataFrame, folder: str, kind: str = "B", block: int = BLOCK, vocabulary: str = wordbpe.VOCABULARY) -> DataFrame:
    """Writes every document's ids with the end id, ascending by doc_id, and returns the manifest, already written:
    (shard, path, n_docs, n_ids, base), base being the number of ids in the shards before.

    Null texts are the end id alone, null doc_ids come first, repeated rows are all written. One range exchange of the
    texts, in which rows of one doc_id are told apart by text and row, so that a frequent id is spread over shards; only the
    manifest, a row for each shard, meets in one task.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        own, end, task = wordbpe.encoder(vocabulary), wordbpe.END.to_bytes(4, "little"), TaskContext.get()
        writer = None
        for keys, texts in wordbpe.grouped(rows_of(batches, "k", "t")):
            if writer is None:
                store, top = fs.FileSystem.from_uri(folder)
                store.create_dir(top, recursive=True)
                name = f"shard-{task.partitionId():08d}-{task.taskAttemptId()}.svtok"
                stream = store.open_output_stream(f"{top}/{name}")
                writer = ShardWriter(stream, kind, block)
            for key, ids in zip(keys, own.encode_all(texts), strict=True):
                writer.add(key, ids + end)
        if writer is not None:
            n_docs, n_ids = writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), f"{folder}/{name}", n_docs, n_ids)], ["shard", "path", "n_docs", "n_ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("k"), F.xxhash64(text_or_empty()).alias("h"), F.monotonically_increasing_id().alias("n"), text_or_empty().alias("t"))
    manifest = slim.repartitionByRange("k", "h", "n").sortWithinPartitions("k", "h", "n").select("k", "t").mapInArrow(run, "shard long, path string, n_docs long, n_ids long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    with scratch(docs.sparkSession) as keep:
        whole = written(written(manifest, "shards").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")
        keep(whole)
    return whole


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files; a task holds one block at a time."""
    short_batches(manifest.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for paths, bases in rows_of(batches, "path", "base"):
            for path, base in zip(paths, bases, strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as stream:
                    out: list[tuple] = []
                    for key, start, parts in ShardReader(stream, stream.size()).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p.tobytes(), crc)
                        out.append((key, base + start, sum(map(len, parts)), crc))
                        if len(out) == 10_000:
                            yield batch(pa, out)
                            out = []
                    if out:
                        yield batch(pa, out)

    def batch(pa, rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return manifest.select("shard", "path", "base").repartition(shards, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), new_folder(spark, "tokens")))
