"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

A document goes to the open sequence after which the sum over gaps ``g`` of ``N(g) ** 2``, with ``N(g)`` open sequences that
have ``g`` free places, is smallest: the rule avoids piling up many sequences with the same awkward gap. A new sequence is
opened only where no open one has room, as the sequences are to be few.
Pieces are dealt by a hash of their row's number to groups of a bounded number of pieces, whatever ids repeat; each group is
packed by one task, longest pieces first, and nothing of the corpus meets on the driver. A group wastes less than about one sequence, which
is a share of 1 / 5,000 at the production group size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import wordbpe
from sieveline.llm.common import rows_of, short_batches, table, text_or_empty, written

CAPACITY = 4096
#: Pieces packed together by one task: some MB, and enough for the waste of the last sequences not to count.
GROUP_PIECES = 40_000


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = wordbpe.VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with the end id, cut only where longer than
    ``capacity``. Null and empty texts are the end id alone. No shuffle."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, end = wordbpe.encoder(vocabulary), wordbpe.END.to_bytes(4, "little")
        for keys, texts in wordbpe.grouped(rows_of(batches, "k", "t")):
            out: list[tuple] = []
            for key, ids in zip(keys, own.encode_all(texts), strict=True):
                data = ids + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("k"), text_or_empty().alias("t"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence number and offset of each piece, placed in the given order. Ties go to the smallest gap left."""
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    count = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        # By gap left, from 0: the change of the sum for a sequence that had that gap and this size. Full ones count nothing.
        change = 2 * (count[: capacity + 1 - size] - count[size:]) + 2
        change[0] = 1 - 2 * count[size]
        possible = np.flatnonzero(count[size:])
        best = possible[np.argmin(change[possible])] if len(possible) else -1
        if best >= 0:
            gap = int(best) + size
            chosen = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, chosen, used = capacity, used, used + 1
        bins[k], offsets[k] = chosen, capacity - gap
        if gap > size:
            count[gap - size] += 1
            waiting[gap - size].append(chosen)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32; a stored table, whose rows have a number) with sequence_id and offset.

    The number of groups follows the number of pieces, so that a task's memory does not grow with the corpus.
    """
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(key, t):  # without annotations: Spark reads them to choose the kind of call
        import pyarrow as pa

        t = t.drop_columns(["g"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(t["length"].to_numpy(), capacity)
        base = key[0].as_py() << 32
        return t.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: one row per piece.

    Empty input gives no rows, repeated rows are packed as often as they come, null doc_ids are kept.
    """
    return pack(written(cut_documents(docs, capacity), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
