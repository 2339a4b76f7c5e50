"""Near duplicates on word shingles: MinHash signatures, and a multi-index Hamming join that finds close ones.

A text's set is its distinct shingles of five words. Minima of random orders of the set, a byte each, are its signature;
two sets of similarity J differ in about a share 1 - J of the places. The signature is cut into chunks and each chunk is
looked up with each of its places left out: by the pigeonhole principle all pairs that differ in fewer places than twice the
chunks share such a key, and that is all pairs that count as near. ``SIZES`` has places and chunks for each threshold.

The stages, none of which brings a group to one task or the driver:

1. Equal sets are one from here on, represented by their smallest doc_id (combined before the exchange).
2. Keys that several sets have are buckets. Sets of a bucket whose signatures differ in at most ``near`` places are linked
   by a spanning forest. A bucket of more than ``BLOCK`` sets is cut into blocks, differently for each key, and a set takes
   part in the blocks of its ``LARGE`` largest buckets only: a large group of near copies is one component after that. In
   every large bucket where it is not, the sets outside the bucket's largest component meet all others
   (``_rest_in_cells``), so that no pair is left out.
3. The components of these links are clusters: linked documents lie in one cluster, and most clusters are small.
4. The full sets of a small cluster meet in one cell: pairs near in signature are confirmed, nearest first; pairs already
   known to be connected need no confirmation. A large cluster has a hub, the member nearest to the most frequent
   signature; every member is compared with the hub, and only members that are not linked to it meet the others.
5. The components of the confirmed links are the result.

Rows are so copied for the part of a group only that stays outside its largest component, and a cell has two blocks.

By the binomial distribution, 8 of a million pairs at similarity 0.85 differ in more than ``near`` places, with the size for 0.8
5 of 10 million pairs at 0.8; of closer pairs fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import TwoGenerations, rows_of, scratch, short_batches, table, text_or_empty, written
from sieveline.llm.components import components

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85


class Size(NamedTuple):
    """Places of a signature, its chunks, and the differing places up to which a pair is confirmed on the full sets."""

    places: int
    chunks: int
    near: int


#: By the least percentage that they serve; ``near`` is five standard deviations above the mean there.
SIZES = {85: Size(72, 13, 25), 80: Size(128, 25, 49)}
PLACES, CHUNKS, NEAR = SIZES[PERCENT]
#: Sets in a block of a bucket or cluster, on average; a cell holds two blocks at most.
BLOCK = 400
#: Of the large buckets that a set is in, those in which its blocks are looked at first, the largest ones.
LARGE = 3

_RNG = np.random.default_rng(20_240_229)
_MOST = max(size.places for size in SIZES.values())
_TIMES = _RNG.integers(0, 1 << 63, _MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, _MOST, dtype=np.uint64)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def size_for(percent: int) -> Size:
    """The smallest size that serves a threshold."""
    fit = [least for least in SIZES if least <= percent]
    if not fit:
        raise ValueError(f"signatures are sized for {min(SIZES)} % or more, not for {percent} %")
    return SIZES[max(fit)]


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


_words = TwoGenerations(_word_hash, 200_000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """The text's set as sorted distinct 64-bit hashes; with fewer words than a shingle, the whole sequence is one."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(WORDS, len(h))):
        out += _mixed(h[k : k + n] + _STEP[k]) * _STEP[k]
    return np.unique(_mixed(out))


def signature(shingle_set: np.ndarray, places: int = PLACES) -> bytes:
    least = np.full(places, np.iinfo(np.uint64).max)
    for start in range(0, len(shingle_set), 512):
        part = shingle_set[start : start + 512]
        least = np.minimum(least, ((part[None, :] ^ _PLUS[:places, None]) * _TIMES[:places, None]).min(axis=1))
    return (_mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def bucket_keys(signatures: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """For each row of places, the keys of its chunks with one place left out; a key holds the place and the rest whole.

    Chunks differ in length by one at most and have at most eight places.
    """
    rows = signatures.astype(np.int64)
    out = np.empty(rows.shape, np.int64)
    for chunk in np.array_split(np.arange(rows.shape[1]), chunks):
        for gone in chunk.tolist():
            rest = np.zeros(len(rows), np.int64)
            for place in chunk.tolist():
                if place != gone:
                    rest = rest << 8 | rows[:, place]
            out[:, gone] = gone << 56 | rest
    return out


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def near_pairs(sig: np.ndarray, near: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row, the later rows that differ in at most ``near`` places, and by how many."""
    for k in range(len(sig) - 1):
        apart = np.count_nonzero(sig[k + 1 :] != sig[k], axis=1)
        close = np.flatnonzero(apart <= near)
        if len(close):
            yield k, close + k + 1, apart[close]


def shingle_table(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """(doc_id, n_shingles, same, sig), written: ``same`` is a 128-bit digest of the set, null for empty ones."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for keys, texts in rows_of(batches, "k", "t"):
            count, same, sig = [], [], []
            for text in texts:
                s = shingles(text)
                count.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s, places) if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(count, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "same", "sig"])

    slim = docs.select(F.col("doc_id").cast("long").alias("k"), text_or_empty().alias("t"))
    return written(slim.mapInArrow(run, "doc_id long, n_shingles long, same binary, sig binary"), "shingles")


def _keys(sets: DataFrame, size: Size) -> DataFrame:
    """(key, rep) of every set: a row for each place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, size.places)
            keys = bucket_keys(sigs, size.chunks)
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(rep)], ["key", "rep"])

    return sets.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("g", "cell", "rep", *columns).repartition("g", "cell").sortWithinPartitions("g", "cell", "rep")


def _blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK).cast("int")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (g, rep, size) with what ``groups`` (g, size) tells of their group. A group's row is copied for each of its
    blocks, so that the rows of a large group are dealt to several tasks."""
    each = groups.withColumn("b", F.explode(F.sequence(F.lit(0), _blocks(F.col("size")) - 1))).drop("size")
    return rows.withColumn("b", F.pmod(F.xxhash64("rep"), _blocks(F.col("size"))).cast("int")).join(each, ["g", "b"])


def _rest_in_cells(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (g, rep, size, main) of groups whose main part is known to be connected, dealt to cells so that every pair but those
    of the main part meets: both parts lie in blocks, a cell has a block of the rest and one of the main part, or two of the
    rest. Groups without a rest take no part."""
    sizes = rows.groupBy("g", "size").agg(F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_rest")).where("n_rest > 0")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).cast("int"))
    counted = _with_group(salted, sizes).withColumns({"of_main": _blocks(F.col("n_main")), "of_rest": _blocks(F.col("n_rest"))})
    mine = F.when(F.col("main"), F.col("salt") % F.greatest("of_main", F.lit(1))).otherwise(F.col("salt") % F.greatest("of_rest", F.lit(1)))
    # A main block b and a rest block r meet in the cell -1 - (b * of_rest + r).
    meets = lambda size, cell: F.when(F.col(size) > 0, F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), cell)).otherwise(F.array().cast("array<int>"))
    with_rest = meets("of_rest", lambda r: -1 - (F.col("mine") * F.col("of_rest") + r))
    with_main = meets("of_main", lambda b: -1 - (b * F.col("of_rest") + F.col("mine")))
    among = meets("of_rest", lambda other: F.least("mine", other) * F.col("of_rest") + F.greatest("mine", other))
    cells = F.when(F.col("main"), with_rest).otherwise(F.concat(with_main, among))
    return _dealt(counted.withColumn("mine", mine).withColumn("cell", F.explode(cells)), "main", *columns)


def _cells(batches: Iterator, *columns: str) -> Iterator[tuple[list, ...]]:
    """The rows of one cell after the other, from sorted batches; columns as lists."""
    held: list[list] = [[] for _ in columns]
    last = None
    for g, cell, *values in rows_of(batches, "g", "cell", *columns):
        start = 0
        ids = list(zip(g, cell, strict=True))
        for k, key in enumerate(ids):
            if key != last:
                for h, v in zip(held, values, strict=True):
                    h.extend(v[start:k])
                if held[0]:
                    yield tuple(held)
                held, last, start = [[] for _ in columns], key, k
        for h, v in zip(held, values, strict=True):
            h.extend(v[start:])
    if held[0]:
        yield tuple(held)


def _links_out(pa, pairs: list[tuple[int, int]]):
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _forests(batches: Iterator, size: Size) -> Iterator:
    """Links of each cell of (rep, sig[, main]): a spanning forest of the pairs near in signature, without known ones."""
    import pyarrow as pa

    out: list[tuple[int, int]] = []
    told: set[tuple[int, int]] = set()
    for reps, sigs, mains in _cells(batches, "rep", "sig", "main"):
        if len(reps) < 2:
            continue
        forest, found = _known(mains), []
        for k, close, _ in near_pairs(np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, size.places), size.near):
            found += [(reps[k], reps[j]) for j in close.tolist() if forest.join(k, j)]
        fresh = [p for p in found if p not in told]
        if len(told) > 200_000:
            told.clear()
        told.update(fresh)
        out += fresh
        if len(out) > 20_000:
            yield _links_out(pa, out)
            out = []
    if out:
        yield _links_out(pa, out)


def _known(mains: list[bool]) -> Forest:
    """A forest in which the main part is one tree."""
    forest = Forest(len(mains))
    main = [k for k, m in enumerate(mains) if m]
    for k in main[1:]:
        forest.up[k] = main[0]
    return forest


def near_signatures(sets: DataFrame, size: Size = SIZES[PERCENT]) -> DataFrame:
    """(node, component) that connects all sets that share a key and differ in at most ``near`` places; ``sets``: (rep, sig)."""
    full = written(_keys(sets, size).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    rows = written(_keys(sets, size).join(full, "key"), "matched")
    few, many = rows.where(F.col("size") <= BLOCK), rows.where(F.col("size") > BLOCK)
    # Sets of one group share most of their large buckets: a few of them connect it.
    ranked = many.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("size", "key")), asc=False).alias("ks"))
    chosen = ranked.select("rep", F.explode(F.slice("ks", 1, LARGE)).alias("k")).select("k.key", "rep", "k.size")
    block = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("rep", "key"), _blocks(F.col("size")))).otherwise(0).cast("int")
    cells = few.unionByName(chosen).join(sets.select("rep", "sig"), "rep").select(F.col("key").alias("g"), block.alias("cell"), "rep", "sig", F.lit(False).alias("main"))
    links = written(_dealt(cells, "sig", "main").mapInArrow(lambda batches: _forests(batches, size), "a long, b long").distinct(), "near")
    found = components(links)
    if many.isEmpty():
        return found
    # What blocks did not connect: in each large bucket, sets outside its largest component meet all others.
    part = many.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("key").alias("g"), "rep", "size", F.coalesce("component", "rep").alias("of"))
    part = written(part, "parts")
    per = part.groupBy("g", "size", "of").agg(F.count("*").alias("n"))
    most = written(per.groupBy("g", "size").agg(F.max_by("of", F.struct("n", "of")).alias("most"), F.count("*").alias("parts")).where("parts > 1"), "most")
    if most.isEmpty():
        return found
    rest = _with_group(part, most).select("g", "rep", "size", (F.col("of") == F.col("most")).alias("main")).join(sets.select("rep", "sig"), "rep")
    more = written(_rest_in_cells(rest, "sig").mapInArrow(lambda batches: _forests(batches, size), "a long, b long").distinct(), "near")
    return found if more.isEmpty() else components(links.unionByName(more))


def alike(small: np.ndarray, large: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted sets."""
    if len(small) > len(large):
        small, large = large, small
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int(np.count_nonzero(large[at] == small))
    return 100 * shared >= percent * (len(small) + len(large) - shared)


def _linked_to_hub(members: DataFrame, size: Size, percent: int) -> DataFrame:
    """(rep, g, hub, main) of the members (rep, g, size, set, sig) of large clusters, written: ``main`` where the member is
    linked to its cluster's hub. Members lie in blocks, and what is known of a cluster is copied once for each block."""
    place = members.select("g", "size", "sig", F.explode(F.sequence(F.lit(1), F.lit(size.places))).alias("p")).select("g", "size", "p", F.substring("sig", F.col("p"), F.lit(1)).alias("v"))
    mode = place.groupBy("g", "size", "p", "v").agg(F.count("*").alias("n")).groupBy("g", "size", "p").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    usual = written(mode.groupBy("g", "size").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("usual")), "usual")
    apart = F.aggregate("usual", F.lit(0), lambda n, u: n + (F.substring("sig", u["p"], F.lit(1)) != u["v"]).cast("int"))
    hub = _with_group(members.select("g", "rep", "size", "sig"), usual).groupBy("g").agg(F.min_by("rep", F.struct(apart, "rep")).alias("hub"))
    hubs = written(members.select("g", "rep", "size", "set").join(hub.withColumnRenamed("g", "of"), (F.col("g") == F.col("of")) & (F.col("rep") == F.col("hub"))).groupBy("g", "size", "hub").agg(F.min("set").alias("hub_set")), "hubs")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for reps, g, hub, sets, hub_sets in rows_of(batches, "rep", "g", "hub", "set", "hub_set"):
            main = [r == h or alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent) for r, h, s, t in zip(reps, hub, sets, hub_sets, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(g, pa.int64()), pa.array(hub, pa.int64()), pa.array(main)], ["rep", "g", "hub", "main"])

    return written(_with_group(members.select("g", "rep", "size", "set"), hubs).mapInArrow(run, "rep long, g long, hub long, main boolean"), "star")


def confirmed_links(docs: DataFrame, clusters: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect all members of a cluster that are linked; ``clusters``: (rep, cluster, size).

    Members' texts come by a join on doc_id, and only their sets move on.
    """
    size = size_for(percent)

    def to_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for reps, cluster, members, texts in rows_of(batches, "rep", "cluster", "size", "t"):
            sets = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), pa.array(cluster, pa.int64()), pa.array(members, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s, size.places) for s in sets], pa.binary())],
                ["rep", "g", "size", "set", "sig"],
            )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for reps, sets, sigs, mains in _cells(batches, "rep", "set", "sig", "main"):
            if len(reps) < 2:
                continue
            own = [np.frombuffer(s, np.uint64) for s in sets]
            forest, pairs = _known(mains), []
            for k, close, apart in near_pairs(np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, size.places), size.near):
                pairs.append(np.stack([apart, np.full(len(close), k), close]))
            if not pairs:
                continue
            every = np.concatenate(pairs, axis=1)
            every = every[1:, np.argsort(every[0], kind="stable")]
            found = []
            for a, b in every.T.tolist():
                if forest.root(a) != forest.root(b) and alike(own[a], own[b], percent):
                    forest.join(a, b)
                    found.append((reps[a], reps[b]))
            if found:
                yield _links_out(pa, found)

    def members(of: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().alias("t"))
        return texts.join(of, "rep").where("length(t) > 0").mapInArrow(to_sets, "rep long, g long, size long, set binary, sig binary")

    small = _dealt(members(clusters.where(F.col("size") <= BLOCK)).withColumns({"cell": F.lit(0), "main": F.lit(False)}), "set", "sig", "main")
    links = small.mapInArrow(run, "a long, b long")
    large = clusters.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return links
    stored = written(members(large), "members")
    star = _linked_to_hub(stored, size, percent)
    # A repeated doc_id has several rows here, which are one document: it is in the main part if one of them is.
    known = star.groupBy("g", "rep").agg(F.bool_or("main").alias("main"))
    rest = _rest_in_cells(stored.join(known, ["g", "rep"]), "set", "sig").mapInArrow(run, "a long, b long")
    return links.unionByName(star.where("main and rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))).unionByName(rest)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Null and empty texts have the empty set and are linked with nothing; null ids too (their component is null, and they
    are kept). Rows that repeat a doc_id are one document. Empty input gives no rows.
    """
    size = size_for(percent)
    with scratch(docs.sparkSession) as keep:
        rows = shingle_table(docs, size.places)
        usable = rows.where("same is not null and doc_id is not null")
        same = written(usable.groupBy("same").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")), "sets")
        # A doc_id that several sets represent (repeated rows with different texts) is one node of the graph.
        close = near_signatures(same.select("rep", "sig"), size)
        sizes = close.groupBy("component").agg(F.count("*").alias("size"))
        clusters = written(close.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("cluster"), "size"), "clusters")
        # Rows of one doc_id are one document: each of its sets' representatives is linked to it.
        repeated = usable.groupBy("doc_id").agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x <> y").select("doc_id")
        joined = usable.join(repeated, "doc_id").select("doc_id", "same").distinct().join(same.select("same", "rep"), "same").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = components(confirmed_links(docs, clusters, percent).unionByName(joined))
        keep(rows, same, found)
    of_set = same.join(found, same["rep"] == found["node"], "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    result = rows.select("doc_id", "n_shingles", "same").join(of_set, "same", "left")
    return result.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns: the one with the smallest doc_id, and of
    rows that repeat it the one with the smallest text. Rows without an id stay."""
    keep = near_duplicates(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_doc_id")).distinct()
    # The row is one struct, so that its columns may have any names.
    known = docs.where("doc_id is not null").select(F.struct("*").alias("d")).join(keep, F.col("d.doc_id").cast("long") == F.col("kept_doc_id"))
    one = known.groupBy("kept_doc_id").agg(F.min_by("d", F.coalesce("d.text", F.lit(""))).alias("d")).select("d.*")
    return one.unionByName(docs.where("doc_id is null"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
