"""Word BPE by the tokenizers library, with a memo of what frequent words become.

The library normalises (NFC, white space, lower case), splits by a pattern and merges within each match. For texts of code
points below 256 the first two steps are tables over single bytes, so that the matches of many texts are found by array
operations, numbered, and each distinct one is encoded once and remembered. What is new is merged together (``Merger``):
in each turn every match merges its pair of the lowest rank, by array operations over all of them. Texts with other
characters, and texts that hold the name of a special token, which the library turns into that token, go to the library
whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

from sieveline.llm.common import TwoGenerations

VOCABULARY = "word_bpe_49k.json"
#: Id written after each document.
END = 1
#: Entries of a Python worker's memo.
WORDS = 600_000
#: Characters handled by one round of array operations. Longer texts are cut at white space, which no match holds.
ROUND = 1 << 21

#: Known to be split and lower-cased alike by tables and library; everything else goes to the library.
_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa0-\xff]")
_GAP, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
for _kind, _chars in ((_GAP, r"[\t-\r \x85\xa0]"), (_LETTER, r"[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]"), (_NUMBER, r"[0-9\xb2\xb3\xb9\xbc-\xbe]")):
    _KIND[[c for c in range(256) if re.match(_chars, chr(c))]] = _kind
_LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
#: What may follow an apostrophe that begins a match.
_SHORT = np.isin(np.arange(256), list(b"stmd"))
_LONG = (b"re", b"ve", b"ll")


def _gap(text: str, at: int) -> int:
    """The first place from ``at`` on with white space, or the end."""
    found = re.compile(r"[\t-\r \xa0]").search(text, at)
    return found.start() if found else len(text)


def matches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the matches in lower-cased Latin-1 text, and which bytes lie in one."""
    text = np.frombuffer(data, np.uint8)
    kind = _KIND[text]
    new = np.ones(len(text), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    quotes = np.flatnonzero((text[:-1] == 0x27) & new[:-1])
    if len(quotes):
        one, two = text[quotes + 1], text[np.minimum(quotes + 2, len(text) - 1)]
        pair = np.zeros(len(quotes), bool)
        for a, b in _LONG:
            pair |= (one == a) & (two == b) & (quotes + 2 < len(text))
        for found, size in ((_SHORT[one], 2), (pair, 3)):
            new[quotes[found] + 1] = False
            after = quotes[found] + size
            new[after[after < len(text)]] = True
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(text))
    word = kind[first] != _GAP
    return first[word], size[word], kind != _GAP


class Merger:
    """Byte-pair merges of many matches at once.

    A turn merges the pair of lowest rank of each match at all its places, from the left. That is what merging one place after
    the other gives, as a pair that holds a merged token has a higher rank than the merge that made it (checked here).
    """

    NONE = 1 << 30

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str, alphabet: list[str]) -> None:
        self.inner = np.array([vocabulary[c] for c in alphabet], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in alphabet], np.int64)
        self.size = np.int64(max(vocabulary.values()) + 1)
        made = {a + b: rank for rank, (a, b) in enumerate(merges)}
        if len(made) < len(merges) or any(max(made.get(a, -1), made.get(b, -1)) >= rank for rank, (a, b) in enumerate(merges)):
            raise ValueError("merges are not in the order of their making")
        self.token = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        # Open addressing: a key and its rank in the first free slot from its hash on.
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int64)
        pairs = np.array([vocabulary[a] for a, _ in merges], np.int64) * self.size + np.array([vocabulary[b] for _, b in merges], np.int64)
        for key, at, rank in zip(pairs.tolist(), self._slot(pairs).tolist(), range(len(merges)), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty match, given in Latin-1, as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"\n".join(words).decode("latin-1").encode(), np.uint8)
        gap = data == 10
        owner = np.cumsum(gap)[~gap]
        data = data[~gap]
        ids = np.where(np.diff(owner, append=-1) != 0, self.last[data], self.inner[data])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), self.NONE)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._rank(ids[:-1] * self.size + ids[1:]), self.NONE)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(ids)))
            over = least == self.NONE
            if over.any():
                done.append((owner[over], ids[over]))
                ids, owner, rank, least = ids[~over], owner[~over], rank[~over], least[~over]
            merge = rank == least
            if (merge[1:] & merge[:-1]).any():  # of overlapping places every other one, from the left
                place = np.arange(len(merge))
                start = np.maximum.accumulate(np.where(merge & ~np.concatenate([[False], merge[:-1]]), place, 0))
                merge &= (place - start) % 2 == 0
            at = np.flatnonzero(merge)
            ids[at] = self.token[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner = ids[stay], owner[stay]
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        out = ids[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(words))) * 4).tolist()
        return [out[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in whole["added_tokens"]) or r"(?!)", re.I)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = Merger(vocabulary, pairs, suffix, _alphabet())
        self.words = TwoGenerations(self._word, WORDS // 3)

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _whole(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()

    def _word(self, word: bytes) -> bytes:
        return self._whole(word.decode("latin-1"))

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of plain texts that make up one round."""
        data = "\n".join(parts).encode("latin-1").translate(_LOWER)
        until = np.cumsum([len(p) + 1 for p in parts])
        first, size, used = matches(data)
        if not len(first):
            return [b""] * len(parts)
        offsets = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(data, np.uint8)[used])]).dictionary_encode()
        distinct, number = words.dictionary.to_pylist(), words.indices.to_numpy()
        memo = self.words
        fresh = [w for w in distinct if w not in memo and w not in memo.old]
        if fresh:
            memo.put_all(fresh, self.merger.encode(fresh))
        known = list(map(memo.__getitem__, distinct))
        count = np.array([len(k) // 4 for k in known])
        start = np.cumsum(count) - count
        each = count[number]
        total = np.cumsum(each)
        out = np.frombuffer(b"".join(known), np.uint32)[np.repeat(start[number] - (total - each), each) + np.arange(total[-1])].tobytes()
        ends = np.concatenate([[0], total])[np.searchsorted(first, until)] * 4
        return [out[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without an end id."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, parts, held = [], [], 0

        def flush() -> None:
            for k, ids in zip(owners, self._encode(parts), strict=True):
                out[k].append(ids)
            owners.clear()
            parts.clear()

        for k, text in enumerate(texts):
            if _PLAIN.search(text) or "<" in text and self.special.search(text):
                out[k].append(self._whole(text))
                continue
            at = 0
            while at < len(text):
                end = _gap(text, at + ROUND) if len(text) - at > ROUND else len(text)
                owners.append(k)
                parts.append(text[at:end])
                held += end - at
                at = end
                if held >= ROUND:
                    flush()
                    held = 0
        if parts:
            flush()
        return [b"".join(x) for x in out]


def grouped(rows: Iterator[list[list]], limit: int = ROUND) -> Iterator[list[list]]:
    """Rows (their last column holds texts) of several batches together, until the texts reach ``limit`` characters."""
    held: list[list] = []
    size = 0
    for columns in rows:
        held = [a + b for a, b in zip(held, columns, strict=True)] if held else columns
        size += sum(map(len, columns[-1]))
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


@functools.cache
def encoder(vocabulary: str = VOCABULARY) -> WordEncoder:
    """One for each Python worker; the vocabulary file is part of the installed tokenizer package."""
    return WordEncoder(public_tokenizers.path(vocabulary))
