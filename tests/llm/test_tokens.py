"""Byte BPE, token files and packing against the libraries and brute force."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sieveline.llm import bpe, packing, tokenfile, wordbpe
from sieveline.llm.common import TwoGenerations, new_folder, written

from .conftest import ODD

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="session")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="session")
def words():
    return Tokenizer.from_file(public_tokenizers.path(wordbpe.VOCABULARY))


def test_byte_bpe_equals_the_library(library, rows_of):
    own = bpe.encoder()
    texts = [t or "" for _, t in rows_of("documents", "doc_id, text")] + [t or "" for t in ODD]
    texts += [h for _, h in rows_of("pages", "page_id, html")]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(np.frombuffer(ids, "<u4").tolist()) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefgh '.0123 \n\té漢ß́😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_byte_bpe_of_any_text(text):
    own = bpe.encoder()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.core.ranks, special_tokens={})
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_prefix_table_appends_and_edits():
    rng, core = random.Random(5), bpe.encoder().core
    for _ in range(40):
        data = bytes(rng.choice(b"abcdefgh ineration") for _ in range(rng.randrange(1, 150)))
        table = bpe.PrefixTable(core, data)
        for _ in range(4):
            table.append(bytes(rng.choice(b"tion ing") for _ in range(rng.randrange(5))))
            start = rng.randrange(len(table.data) + 1)
            end = rng.randrange(start, len(table.data) + 1)
            table.edit(start, end, bytes(rng.choice(b"thesion ") for _ in range(rng.randrange(6))))
            fresh = bpe.PrefixTable(core, table.data)
            assert table.last == fresh.last and table.ids() == fresh.ids()
            assert b"".join(core.tokens[t] for t in table.ids()) == table.data
    long = bpe.PrefixTable(core, b"the quick brown fox jumps over the lazy dog " * 50)
    assert long.edit(10, 14, b"slow") < 300  # near the edit only


def test_round_trip_query(spark, odd, none, library):
    got = sorted(map(tuple, bpe.round_trip(odd).collect()), key=str)
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(none).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd))
    assert sorted(((r[0], bytes(r[1]).decode()) for r in back.collect()), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=str)


def test_word_bpe_equals_the_library(words, rows_of):
    texts = [t or "" for _, t in rows_of("documents", "doc_id, text")] + [t or "" for t in ODD] + ["ÀÉ ǅ İ ﬁ 1² '", "à", "don't WE'LL"]
    for text, ids in zip(texts, wordbpe.encoder().encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.encode(text, add_special_tokens=False).ids, text[:80]


def test_word_bpe_of_special_tokens_quotes_and_rounds(words, monkeypatch):
    rng, own = random.Random(3), wordbpe.encoder()
    texts = ["a <|endoftext|> b", "<|startoftext|>", "<|ENDOFTEXT|>x", "''''s'", "'", "'r", "it's 'tis 'status we'll've 'v"]
    texts += ["".join(rng.choice("'stmdrevl aB1²?!.\xa0\n\té×<|") for _ in range(rng.randrange(60))) for _ in range(2_000)]
    texts.append(" ".join(texts[7:400]))  # far longer than a round below
    assert words.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]
    want = [words.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (1 << 21, 40):
        monkeypatch.setattr(wordbpe, "ROUND", limit)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all(texts)] == want


def test_merging_many_matches_at_once(words):
    """Repeated pairs, overlaps and words of any length, many in one call, against the library."""
    rng, merger = random.Random(5), wordbpe.encoder().merger
    found = ["a" * n for n in (1, 2, 3, 4, 5, 17, 300)] + ["haha" * 9, "ééééé", "ÿþ".lower(), "..." * 40, "the", "?!"]
    found += ["".join(rng.choice("aabthiené") for _ in range(rng.randrange(1, 40))) for _ in range(3_000)]
    for word, ids in zip(found, merger.encode([w.encode("latin-1") for w in found]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.encode(word, add_special_tokens=False).ids, word
    with pytest.raises(ValueError):
        wordbpe.Merger({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")], "", ["a"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abAB '.0123 \n\té漢ßÀ\xad\xaa²"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_word_bpe_of_any_text(text):
    library = wordbpe.encoder().library
    assert np.frombuffer(wordbpe.encoder().encode_all([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded():
    memo = TwoGenerations(lambda x: x + 1, 10)
    for i in range(1000):
        assert memo[i % 37] == i % 37 + 1
        assert len(memo) <= 10 and len(memo.old) <= 10
    memo.put_all(list(range(100)), list(range(100)))
    assert len(memo) <= 20


@pytest.mark.parametrize("kind", ["B", "b"])
def test_shards_come_back(kind):
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 1 << 32 if k == 3 else 50_000, n, dtype=np.uint64).astype("<u4")) for k, n in enumerate([1, 0, 700, 13, 256, 255, 257, 5])]
    for ids in (docs[2][1], docs[3][1], docs[1][1]):
        assert (tokenfile.join_planes(tokenfile.shuffle_planes(ids, kind), len(ids), kind) == ids).all() if len(ids) else True
    stream = io.BytesIO()
    writer = tokenfile.ShardWriter(stream, kind, block=256)
    for k, ids in docs:
        writer.add(k, ids.tobytes())
    assert writer.close() == (len(docs), sum(len(x) for _, x in docs))
    reader = tokenfile.ShardReader(stream, len(stream.getvalue()))
    start = 0
    for (k, ids), (key, at, parts) in zip(docs, reader.documents(), strict=True):
        assert (key, at) == (k, start) and b"".join(p.tobytes() for p in parts) == ids.tobytes()
        start += len(ids)
    assert (reader.read_block(1) == np.concatenate([x for _, x in docs])[256:512]).all()  # without the blocks before
    with pytest.raises(ValueError):
        tokenfile.ShardReader(io.BytesIO(stream.getvalue()[:-3]), len(stream.getvalue()) - 3)


def check_files(got, docs, words):
    """Ascending doc_ids (null first), no gaps, and of each doc_id the right documents in any order."""
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda k: (k is not None, k or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = {t: np.array(words.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in {t or "" for _, t in docs}}
    want = [(k, len(ids[t or ""]), zlib.crc32(ids[t or ""].tobytes())) for k, t in docs]
    assert sorted(((k, n, crc) for k, _, n, crc in got), key=str) == sorted(want, key=str)


def test_token_files_query(spark, odd, none, words):
    check_files(tokenfile.read_shards(tokenfile.write_shards(odd, new_folder(spark, "t"))).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], words)
    assert tokenfile.read_shards(tokenfile.write_shards(none, new_folder(spark, "t"))).count() == 0


def test_a_frequent_id_is_spread_over_shards_and_groups(spark, words):
    rows = [(7 if k % 4 else k, f"text {k % 50}", 1) for k in range(4_000)] + [(None, None, 1)] * 4_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the shards were large
    try:
        manifest = tokenfile.write_shards(docs, new_folder(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["n_docs"] for r in manifest.collect()) < 4_000 and manifest.count() > 2
    check_files(tokenfile.read_shards(manifest).collect(), [r[:2] for r in rows], words)
    ids = {t: words.encode(t or "", add_special_tokens=False).ids + [1] for _, t, _ in rows}
    packed = packing.pack(written(packing.cut_documents(docs), "pieces"), group_pieces=500).collect()
    check_packed(packed, [(k, ids[t]) for k, t, _ in rows], 4096)
    assert len({r["sequence_id"] >> 32 for r in packed}) == 16
    assert max(Counter(r["sequence_id"] >> 32 for r in packed).values()) < 700


def brute_sum_of_squares(lengths, capacity):
    """Sequence sizes by trying every gap for every piece."""
    gaps = defaultdict(int)
    for size in lengths:
        def cost(gap):
            trial = dict(gaps)
            trial[gap] = trial.get(gap, 0) - 1
            trial[gap - size] = trial.get(gap - size, 0) + 1
            return sum(n * n for g, n in trial.items() if 0 < g < capacity)

        open_gaps = [g for g, n in gaps.items() if n and size <= g]
        best = min(sorted(open_gaps), key=cost, default=None)
        if best is None:
            best = capacity
        else:
            gaps[best] -= 1
        if best > size:
            gaps[best - size] += 1
    return sorted(g for g, n in gaps.items() for _ in range(n))


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(rng.integers(5, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 60)))
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        used = defaultdict(int)
        for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True):
            assert o == used[b]
            used[b] += n
        assert all(u <= capacity for u in used.values())
        assert sorted(capacity - u for u in used.values() if u < capacity) == brute_sum_of_squares(lengths.tolist(), capacity)
    with pytest.raises(ValueError):
        packing.sum_of_squares(np.array([6]), 5)


def check_packed(rows, want, capacity):
    """Every token of every document once, sequences without gaps or overflow."""
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    expected = defaultdict(list)
    for key, ids in want:
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            expected[key].append((piece, at, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, odd, none, words, data, rows_of):
    ids = lambda t: words.encode(t or "", add_special_tokens=False).ids + [1]
    check_packed(packing.pack_documents(odd, 64).collect(), [(r["doc_id"], ids(r["text"])) for r in odd.collect()], 64)
    assert packing.pack_documents(none).count() == 0
    want = [(k, ids(t)) for k, t in rows_of("documents", "doc_id, text")]
    n = check_packed(packing.op10_best_fit_packing(spark, data).collect(), want, 4096)
    assert n <= -(-sum(len(x) for _, x in want) // 4096) * 1.02 + 1
    many = packing.pack(packing.cut_documents(spark.read.parquet(f"{data}/documents.parquet"), 256), 256, group_pieces=40)
    check_packed(many.collect(), want, 256)
