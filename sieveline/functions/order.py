"""Whether rows lie in order, compared by whole arrays where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows (keys, file, at) that follow each other in a file, the first and the last (``last``), and beside the first
    ``wrong``, how many of them are smaller than the one before. Nulls come first."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "at"))
        new = np.concatenate([[True], (file[1:] != file[:-1]) | (at[1:] != at[:-1] + 1)])
        wrong = np.concatenate([[False], _greater([batch.column(k) for k in keys])]) & ~new
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        rows = pa.array(np.concatenate([first, last]))
        counts = np.concatenate([np.add.reduceat(wrong.astype(np.int64), first), np.zeros(len(last), np.int64)])
        ends = pa.array(np.arange(len(rows)) >= len(first))
        yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], ends, pa.array(counts)], names=[*batch.schema.names, "last", "wrong"])


def _greater(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the last is greater than the next one."""
    n = len(columns[0]) - 1
    greater, same = np.zeros(n, bool), np.ones(n, bool)
    for c in columns:
        c = c.cast(pa.int8()) if pa.types.is_boolean(c.type) else c
        a, b = c.slice(0, n), c.slice(1)
        here, there = (x.is_valid().to_numpy(zero_copy_only=False) for x in (a, b))
        more, equal = (f(a, b).fill_null(False).to_numpy(zero_copy_only=False) for f in (pc.greater, pc.equal))
        greater |= same & (more | (here & ~there))
        same &= equal | ~(here | there)
    return greater
