"""Postings of tokenised documents, made by operations on whole arrays of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are sorted at once; a longer document is sorted alone.
AT_ONCE = 1_000_000


def by_term(batches: Iterator[pa.RecordBatch], empty: bool) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, exact, stemmed, field_length) from (doc_id, field_length, texts, and stems beside them if there are any),
    texts being lists of tokens, whose places start anew in each. ``empty``: a document without a token has a row with a null
    term."""
    for batch in batches:
        texts = batch.column("texts")
        inner = texts.flatten()
        ends = np.cumsum(_lengths(inner))
        ends = np.concatenate([[0], ends])[np.cumsum(_lengths(texts))]  # tokens up to the end of each row
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
            yield _postings(batch.slice(begin, end - begin), empty)
            begin = end


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rank(values: pa.Array) -> np.ndarray:
    """Place of each value in their order; strings are compared by their bytes, as Spark does."""
    rank = np.empty(len(values), np.int64)
    rank[pc.sort_indices(values).to_numpy(zero_copy_only=False)] = np.arange(len(values))
    return rank


def _lists(counts: np.ndarray, places: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(places.astype(np.int32)))


def _postings(batch: pa.RecordBatch, empty: bool) -> pa.RecordBatch:
    texts = batch.column("texts")
    inner = texts.flatten()
    words, counts = inner.flatten(), _lengths(inner)
    row = np.repeat(np.repeat(np.arange(batch.num_rows), _lengths(texts)), counts)
    pos = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    stem = None
    if "stems" in batch.schema.names:
        words = pa.concat_arrays([words, batch.column("stems").flatten().flatten()])
        row, pos, stem = np.tile(row, 2), np.tile(pos, 2), np.arange(2 * len(pos)) >= len(pos)
    if words.null_count:
        there = words.is_valid()
        at = there.to_numpy(zero_copy_only=False)
        words, row, pos, stem = words.filter(there), row[at], pos[at], None if stem is None else stem[at]
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # By term and document, as segments are: what sorts many of these batches later has long runs to merge.
    key = _rank(coded.dictionary)[code] * batch.num_rows + _rank(batch.column("doc_id"))[row]
    # Tokens of a document come by place; only stems, and texts that share an id, are out of this order.
    order = np.argsort(key, kind="stable") if stem is None and len(inner) == batch.num_rows else np.lexsort((pos, np.zeros(len(pos), bool) if stem is None else stem, key))
    key, pos = key[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    if stem is None:
        exact, stemmed = _lists(sizes, pos), _lists(np.zeros(len(first), np.int64), pos[:0])
    else:
        stem = stem[order]
        later = np.add.reduceat(stem.astype(np.int64), first) if len(first) else sizes
        exact, stemmed = _lists(sizes - later, pos[~stem]), _lists(later, pos[stem])
    docs, terms = row[order][first], coded.dictionary.take(pa.array(code[order][first]))
    if empty and len(without := np.flatnonzero(np.bincount(row, minlength=batch.num_rows) == 0)):
        docs = np.concatenate([without, docs])
        terms, exact, stemmed = (pa.concat_arrays([pa.nulls(len(without), a.type), a]) for a in (terms, exact, stemmed))
    docs = pa.array(docs)
    return pa.RecordBatch.from_arrays([terms, batch.column("doc_id").take(docs), exact, stemmed, batch.column("field_length").take(docs)], names=["term", "doc_id", "exact", "stemmed", "field_length"])
