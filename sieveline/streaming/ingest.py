"""A stream of operations into a field's log.

Each micro-batch becomes two batches of the log, its deletes and its inserts. Their seqs are reserved by a file before
anything is written, and a batch that Spark delivers again after a failure gets the same ones: what was written to its end
is left alone, what was not is overwritten. A micro-batch is so appended once, wherever the failure came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sieveline.plans.index import FieldIndex


def append_batch(index: FieldIndex, batch: DataFrame, batch_id: int, to_entries: Callable[[DataFrame], DataFrame], compact_every: int = 0, stream: str = "stream") -> None:
    """``batch`` has (op, doc_id, ...); of a document both deleted and inserted in one batch, the delete counts first.
    ``stream`` names the stream, of which an index may have several."""
    name = f"{stream}.{batch_id}"
    first = index.reserved().get(name)
    if first is None:
        first = index.next_seq()
        index.store.write("", "streamed", f"{name}-{first}")
    covered = index.store.manifest()["covers"]
    if first > covered and not index.whole(first):
        index.delete(batch.where("op = 'delete'").select("doc_id").distinct(), seq=first)
    if first + 1 > covered and not index.whole(first + 1):
        index.insert(to_entries(batch.where("op = 'insert'")), seq=first + 1)
    if compact_every and (batch_id + 1) % compact_every == 0:
        index.compact(index.store.current() + 1)


def stream_into(index: FieldIndex, source: DataFrame, to_entries: Callable[[DataFrame], DataFrame], checkpoint: str, compact_every: int = 0, stream: str = "stream", **trigger) -> StreamingQuery:
    """Start the query; ``trigger`` goes to ``DataStreamWriter.trigger`` (all that is there and stop, by default)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        append_batch(index, batch, batch_id, to_entries, compact_every, stream)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
