"""Byte-level BPE by prefix dynamic programming.

For a byte string, every prefix has exactly one last token with which its BPE encoding ends. ``PrefixEncoder`` stores
that token for each prefix; the encoding is read by walking back from the end. The table of a string is a prefix of the
table of any string that extends it, so appends are exact and only cost the new bytes, and after an edit the table is
recomputed only until it agrees again with the old one. All pieces (words) share one bounded prefix memo.

The last token of prefix ``p`` is the token ``t``, a suffix of ``p``, for which ``(last token of p without t, t)`` is a
pair that BPE itself would leave unmerged. That is tested by undoing merges on both sides of the seam in reverse order.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import TwoGenerations, rows_of, short_batches, table, text_or_empty

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of the memos of a Python worker: pieces, and byte prefixes.
PIECES, PREFIXES = 750_000, 60_000
#: Longer pieces are encoded one by one, with a table of their own.
MANY = 48

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r\x1c-\x20\x85\xa0"


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The splitting pattern for texts of code points below 256, where the properties are short explicit sets."""
    if pattern != public_tokenizers.PATTERN:
        return None
    # \x1c-\x1f are no Unicode white space, so that \s is spelled out here too.
    space = "\t-\r \x85\xa0"
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{space}{_LETTERS}{_NUMBERS}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixEncoder:
    """BPE over byte strings by ``ranks``; the same ids as merging by lowest rank first."""

    def __init__(self, ranks: dict[bytes, int], prefixes: int = PREFIXES) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.size = len(ranks)
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.last = TwoGenerations(self._last_of, prefixes // 2)

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; the token twice if no merge of others does."""
        known = self.halves.get(token)
        if known is None:
            known = self.halves[token] = self._split(token)
        return known

    def _split(self, token: int) -> tuple[int, int]:
        word = self.tokens[token]
        parts = [word[i : i + 1] for i in range(len(word))]
        if any(p not in self.ranks for p in parts):
            return token, token
        while len(parts) > 2:
            best = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= token:
                return token, token
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.tokens[token]) == 1 or self.split(token) != (token, token)

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves the seam between the two tokens as it is."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        limit = float("inf")
        tokens, ranks = self.tokens, self.ranks
        while True:
            merged = ranks.get(tokens[left] + tokens[right])
            if merged is not None and merged < limit and self.split(merged) == (left, right):
                return False
            # Undo the merge that was made last; on the right side a merge of equal rank comes after.
            if left > right and len(tokens[left]) > 1 or len(tokens[right]) == 1:
                if len(tokens[left]) == 1:
                    return True
                limit, left = left, self.split(left)[1]
            else:
                limit, right = right + 1, self.split(right)[0]

    def _last_of(self, prefix: bytes) -> int:
        n, ranks = len(prefix), self.ranks
        for start in range(max(0, n - self.longest), n):
            token = ranks.get(prefix[start:])
            if token is not None and self.reachable(token) and (not start or self.stays(self.last[prefix[:start]], token)):
                return token
        raise ValueError("a byte is not in the vocabulary")

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. A piece that is itself a token stays whole, as in the published encoder."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 400:
            return PrefixTable(self, piece).ids()
        out: list[int] = []
        last, tokens, n = self.last, self.tokens, len(piece)
        while n:
            if len(piece) > 24 and n == len(piece):
                for k in range(1, n, 16):  # fills the memo from the front: no deep recursion
                    last[piece[:k]]
            token = last[piece[:n]]
            out.append(token)
            n -= len(tokens[token])
        return out[::-1]


class PrefixTable:
    """The stored last token of every byte prefix of one string, with exact appends and edits."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b"") -> None:
        self.encoder, self.data, self.last = encoder, b"", array("I")
        self.append(data)

    def _next(self, data: bytes, n: int, last: array) -> int:
        e = self.encoder
        for start in range(max(0, n - e.longest), n):
            token = e.ranks.get(data[start:n])
            if token is not None and e.reachable(token) and (not start or e.stays(last[start - 1], token)):
                return token
        raise ValueError("a byte is not in the vocabulary")

    def append(self, more: bytes) -> PrefixTable:
        self.data += more
        for n in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._next(self.data, n, self.last))
        return self

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace ``data[start:end]`` by ``new``; returns how many entries were computed anew.

        The entry at a place depends on the ``longest`` bytes and entries before it. Once so many entries after the
        edit equal the old ones, all later ones do, and are kept.
        """
        old, data = self.last, self.data[:start] + new + self.data[end:]
        last, shift, same = old[:start], len(new) - (end - start), 0
        n = start
        while n < len(data):
            n += 1
            last.append(self._next(data, n, last))
            behind = n - start - len(new)
            if behind > 0:
                same = same + 1 if last[-1] == old[n - 1 - shift] else 0
                if same >= self.encoder.longest:
                    break
        done = n - start
        last.extend(old[n - shift :])
        self.data, self.last = data, last
        return done

    def ids(self) -> list[int]:
        n, out = len(self.data), []
        while n:
            out.append(self.last[n - 1])
            n -= len(self.encoder.tokens[out[-1]])
        return out[::-1]


class ManyEncoder:
    """The same table of last tokens for many short pieces at once, one place of all pieces after the other.

    Tokens are found by the polynomial hash of their bytes; the result is compared with the pieces' bytes, and a block that
    differs (a hash collision) is encoded by the plain encoder.
    """

    BASE, SPREAD = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93

    def __init__(self, core: PrefixEncoder) -> None:
        self.core = core
        tokens = [(data, token) for token, data in core.tokens.items() if len(data) <= MANY and core.reachable(token)]
        self.lengths = np.zeros(max(core.tokens) + 1, np.int64)
        for token, data in core.tokens.items():
            self.lengths[token] = len(data)
        self.power = np.array([pow(self.BASE, k, 1 << 64) for k in range(MANY + 1)], np.uint64)
        keys = np.array([self._hash(data) for data, _ in tokens], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([token for _, token in tokens], np.int64)[order]
        # Where the keys with given high bits begin.
        self.shift = np.uint64(64 - 21)
        self.begin = np.searchsorted(self.keys >> self.shift, np.arange(1 << 21, dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.bincount((self.keys >> self.shift).astype(np.int64)).max())
        self.longest = max(len(data) for data, _ in tokens)
        #: Tokens that merging their bytes does not give: only a piece that is one gets it.
        self.odd = {data for token, data in core.tokens.items() if not core.reachable(token)}
        self.pair_keys, self.pair_stays = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _hash(self, data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * self.BASE + b + 1) % (1 << 64)
        return h * self.SPREAD % (1 << 64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Tokens with these hashes, or -1."""
        h = h * np.uint64(self.SPREAD)
        at = self.begin[(h >> self.shift).astype(np.int64)]
        found = np.full(len(h), -1, np.int64)
        for d in range(self.depth):
            here = np.minimum(at + d, len(self.keys) - 1)
            hit = self.keys[here] == h
            found[hit] = self.values[here[hit]]
        return found

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = (key * -7046029254386353131 >> 40) & 0xFFFFF
        unknown = np.flatnonzero(self.pair_keys[slot] != key)
        out = self.pair_stays[slot]
        if len(unknown):
            fresh, back = np.unique(key[unknown], return_inverse=True)
            stays = np.array([self.core._stays(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()], bool)
            out[unknown] = stays[back]
            self.pair_keys[slot[unknown]], self.pair_stays[slot[unknown]] = key[unknown], out[unknown]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes of unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        for k in np.flatnonzero((size > MANY) | (size == 0)).tolist():
            out[k] = array("I", self.core.encode(pieces[k])).tobytes() if pieces[k] else b""
        order = np.flatnonzero((size <= MANY) & (size > 0))
        order = order[np.argsort(size[order], kind="stable")]
        for start in range(0, len(order), 1 << 15):
            self._block(pieces, order[start : start + (1 << 15)], size, out)
        return out

    def _block(self, pieces: list[bytes], rows: np.ndarray, size: np.ndarray, out: list[bytes]) -> None:
        """Fills in the rows, which are sorted by size."""
        sizes, m = size[rows], len(rows)
        width = int(sizes[-1])
        joined = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in rows.tolist()]), np.uint8).reshape(m, width)
        hashes = np.zeros((width + 1, m), np.uint64)
        for n in range(width):
            hashes[n + 1] = hashes[n] * np.uint64(self.BASE) + (joined[:, n].astype(np.uint64) + np.uint64(1))
        last = np.full((width + 1, m), -1, np.int64)
        for n in range(1, width + 1):
            todo = np.arange(np.searchsorted(sizes, n), m)
            for length in range(min(n, self.longest), 0, -1):
                token = self._find(hashes[n][todo] - hashes[n - length][todo] * self.power[length])
                hit = np.flatnonzero(token >= 0)
                if length < n and len(hit):
                    before = last[n - length][todo[hit]]
                    hit = hit[(before >= 0) & self._stay(before, token[hit])]
                if len(hit):
                    last[n][todo[hit]] = token[hit]
                    left = np.ones(len(todo), bool)
                    left[hit] = False
                    todo = todo[left]
                    if not len(todo):
                        break
        # Walk back from the ends of all pieces together.
        at, steps, active = sizes.copy(), [], np.arange(m)
        while len(active):
            token = last[at[active], active]
            steps.append((active, token))
            at[active] -= np.where(token >= 0, self.lengths[token], MANY + 1)
            active = active[at[active] > 0]
        where = np.concatenate([a for a, _ in steps])
        ids = np.concatenate([t for _, t in steps])[::-1]
        by_row = np.argsort(where[::-1], kind="stable")
        data, ends = ids[by_row].astype("<u4").tobytes(), np.cumsum(np.bincount(where, minlength=m)) * 4
        names, values = self.core.tokens, ids[by_row].tolist()
        sound = not at.any() and b"".join([names[t] for t in values]) == b"".join([pieces[k] for k in rows.tolist()])
        begin = 0
        for k, end in zip(rows.tolist(), ends.tolist(), strict=True):
            out[k] = data[begin:end] if sound else array("I", self.core.encode(pieces[k])).tobytes()
            begin = end
        if self.odd:
            for k in rows.tolist():
                if pieces[k] in self.odd:
                    out[k] = self.core.ranks[pieces[k]].to_bytes(4, "little")


class TextEncoder:
    """Whole texts: every match of the pattern is encoded separately. Frequent pieces are memoised."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.core = PrefixEncoder(ranks)
        self.many = ManyEncoder(self.core)
        self.pattern = regex.compile(pattern)
        self.latin = latin_pattern(pattern)
        self.pieces = TwoGenerations(lambda p: array("I", self.core.encode(p.encode())).tobytes(), PIECES // 3)
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]
        self.bytes = [b""] * len(self.names)
        for token, data in self.core.tokens.items():
            self.bytes[token] = data

    def split(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.pattern.findall(text)
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; pieces that no memo has are encoded together."""
        splits, memo = [self.split(t) for t in texts], self.pieces
        fresh = [p for p in set().union(*splits) if p not in memo and p not in memo.old]
        memo.put_all(fresh, self.many.encode([p.encode() for p in fresh]))
        return [b"".join(map(memo.__getitem__, pieces)) for pieces in splits]

    def encode(self, text: str) -> array:
        ids = array("I")
        ids.frombytes(self.encode_all([text])[0])
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.cache
def encoder(vocabulary: str = VOCABULARY) -> TextEncoder:
    """One for each Python worker; the vocabulary file is part of the installed tokenizer package."""
    return TextEncoder(read_ranks(public_tokenizers.path(vocabulary)))


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) of every text; null texts count as empty, empty texts have no ids. Repeated rows stay."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(vocabulary)
        for keys, texts in rows_of(batches, "k", "t"):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([np.frombuffer(x, "<i4") for x in own.encode_all(texts)], pa.list_(pa.int32()))], ["k", "ids"])

    slim = docs.select(F.col(id_column).cast("long").alias("k"), text_or_empty(text_column).alias("t"))
    return slim.mapInArrow(run, "k long, ids array<int>").withColumnRenamed("k", id_column)


def decode_documents(encoded: DataFrame, id_column: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, data binary): the bytes of the ids in order. Null ids count as none."""
    short_batches(encoded.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(vocabulary)
        for keys, ids in rows_of(batches, "k", "ids"):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([own.decode(x or ()) for x in ids], pa.binary())], ["k", "data"])

    return encoded.select(F.col(id_column).cast("long").alias("k"), "ids").mapInArrow(run, "k long, data binary").withColumnRenamed("k", id_column)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both: no shuffle, one pass over the texts."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(vocabulary)
        for keys, texts in rows_of(batches, "k", "t"):
            count, ids_sha, text_sha = [], [], []
            for data in own.encode_all(texts):
                ids = memoryview(data).cast("I").tolist()
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("k"), text_or_empty().alias("t"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
