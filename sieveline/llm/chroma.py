"""Chroma fingerprints of audio in media columns, and alignment of recordings.

A recording's spectrum is folded into twelve pitch classes a frame. Filters compare areas of that picture (time by pitch
class) through its integral image; each gives two Gray-coded bits, and sixteen filters make a 32-bit integer a frame. Two
recordings are aligned by the histogram of the offsets at which they have equal integers; the best offset is judged by the
share of bits that differ over the overlap.

The tables have no audio, so that the query plays each row of ``embeddings`` as a melody (a note for each number) and works
on the samples. Equal fingerprints are one class from there on. The stated queries, rows whose id is divisible by 100, are
searched against all classes: two recordings whose histogram has a vote share an integer, so that a join on integers finds
all pairs there are, without a pass over all classes and queries. Integers that very many recordings have are dealt to
cells of bounded sides. Nothing is sampled or capped, and every match of a class is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import rows_of, scratch, short_batches, table, written

RATE, NOTE, FRAME, HOP = 8_000, 500, 1_024, 250
LOWEST, HIGHEST = 55.0, 3_520.0
WIDEST = 12
#: Shape, first pitch class, pitch classes, frames: each filter compares two halves (or the middle with the sides).
FILTERS = (
    ("all", 0, 3, 12), ("pitch", 0, 4, 12), ("time", 0, 12, 8), ("cross", 2, 6, 8), ("pitch", 4, 8, 6), ("time", 3, 4, 12), ("bands", 0, 9, 6), ("slices", 0, 12, 9),
    ("pitch", 8, 4, 12), ("time", 6, 6, 6), ("cross", 6, 6, 12), ("all", 5, 3, 8), ("bands", 3, 9, 12), ("slices", 4, 6, 12), ("time", 9, 3, 10), ("pitch", 2, 8, 4),
)
#: Logarithmic ratios between which the two bits change.
CUTS = (-0.18, 0.0, 0.18)
#: Bits that may differ in a match, equal integers that it needs at its offset, and places that must overlap; of recordings
#: shorter than that all places count.
MATCH, MIN_VOTES, MIN_OVERLAP = 0.3, 3, 24
#: Places of one integer on either side of a cell of the join, on average.
SPLIT = 2_000

_WINDOW = np.hanning(FRAME).astype(np.float32)
_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = (_HZ >= LOWEST) & (_HZ <= HIGHEST)
_CLASS = np.round(12 * np.log2(_HZ[_USED] / 440.0)).astype(int) % 12
#: Frequencies in order of their class, and where each class starts; every class has some.
_BY_CLASS = np.flatnonzero(_USED)[np.argsort(_CLASS, kind="stable")]
_STARTS = np.searchsorted(np.sort(_CLASS), np.arange(12))


def chroma(samples: np.ndarray) -> np.ndarray:
    """Shares of the pitch classes in each frame, smoothed over five frames; none for less than a frame."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * _WINDOW
    tones = np.fft.rfft(frames, axis=1)[:, _BY_CLASS]
    power = np.add.reduceat(tones.real**2 + tones.imag**2, _STARTS, axis=1)
    total = np.cumsum(np.pad(power, ((3, 2), (0, 0)), mode="edge"), axis=0)
    power = (total[5:] - total[:-5]) if n > 1 else power
    size = np.sqrt((power**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-3, power / np.maximum(size, 1e-3), 0).astype(np.float32)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """An unsigned 32-bit integer for each place where the widest filter fits."""
    picture = chroma(samples.astype(np.float32))
    n = len(picture) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(picture) + 1, 13))
    whole[1:, 1:] = picture.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return whole[at + t1, p1] - whole[at + t0, p1] - whole[at + t1, p0] + whole[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for shape, p, high, wide in FILTERS:
        every = area(0, wide, p, p + high)
        if shape == "all":
            one, other = every, area(0, wide, 0, 12) * high / 12
        elif shape == "pitch":
            one = area(0, wide, p, p + high // 2)
            other = every - one
        elif shape == "time":
            one = area(0, wide // 2, p, p + high)
            other = every - one
        elif shape == "cross":
            one = area(0, wide // 2, p, p + high // 2) + area(wide // 2, wide, p + high // 2, p + high)
            other = every - one
        elif shape == "bands":
            one = area(0, wide, p + high // 3, p + 2 * (high // 3))
            other = (every - one) / 2
        else:
            one = area(wide // 3, 2 * (wide // 3), p, p + high)
            other = (every - one) / 2
        level = np.searchsorted(CUTS, np.log((1 + one) / (1 + other)))
        out = out << np.uint32(2) | np.array([0, 1, 3, 2], np.uint32)[level]
    return out


def overlap(n: int, m: int, offset: int) -> int:
    """Places that two recordings of ``n`` and ``m`` codes share."""
    return max(0, min(n, m + offset) - max(0, offset))


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of bits that differ where ``b`` is laid ``offset`` places after the start of ``a``; 1 without an overlap."""
    start, end = max(0, offset), min(len(a), len(b) + offset)
    if end <= start:
        return 1.0
    return float(np.bitwise_count(a[start:end] ^ b[start - offset : end - offset]).sum() / (32 * (end - start)))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(votes, offset, bit error) of the offset at which most integers of the two are equal; smallest offset first."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, side="right")
    n = high - low
    if not n.sum():
        return 0, 0, 1.0
    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    found, votes = np.unique(np.repeat(np.arange(len(a)), n) - order[at], return_counts=True)
    offset = int(found[votes.argmax()])
    return int(votes.max()), offset, bit_error(a, b, offset)


def is_match(n: int, m: int, votes: int, offset: int, error: float) -> bool:
    """Whether recordings of ``n`` and ``m`` codes that align so are a match."""
    shorter = min(n, m)
    return votes >= min(MIN_VOTES, shorter) and overlap(n, m, offset) >= min(MIN_OVERLAP, shorter) and error <= MATCH


def melody(numbers) -> np.ndarray:
    """Samples that play a note for each number; numbers that are null or no numbers are rests."""
    v = np.array([np.nan if x is None else x for x in numbers], np.float64)
    note = np.round(12 * np.tanh(np.nan_to_num(v) * 4))
    turn = 440 * 2 ** (note / 12) / RATE
    # Each note goes on where the one before ended; whole turns are taken out before the sine of short numbers.
    turns = (np.cumsum(turn * NOTE) - turn * NOTE)[:, None] + turn[:, None] * np.arange(1, NOTE + 1)
    phase = ((turns - np.floor(turns)) * (2 * np.pi)).astype(np.float32)
    tone = np.sin(phase)
    return (np.isfinite(v)[:, None] * (tone + np.float32(0.8) * tone * np.cos(phase))).astype(np.float32).reshape(-1)


def fingerprints(media: DataFrame, id_column: str, samples_of, column: str) -> DataFrame:
    """(rec_id, n_codes, codes binary) of a media column; ``samples_of`` turns its value into samples."""
    short_batches(media.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for keys, values in rows_of(batches, "k", "v"):
            codes = [np.zeros(0, np.uint32) if v is None else fingerprint(samples_of(v)) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(map(len, codes)), pa.int64()), pa.array([c.astype("<u4").tobytes() for c in codes], pa.binary())], ["rec_id", "n_codes", "codes"])

    return media.select(F.col(id_column).cast("long").alias("k"), F.col(column).alias("v")).mapInArrow(run, "rec_id long, n_codes long, codes binary")


def pcm16(value: bytes) -> np.ndarray:
    """Samples of a column of little-endian 16-bit PCM."""
    return np.frombuffer(value[: len(value) // 2 * 2], "<i2").astype(np.float32) / 32768


def _places(prints: DataFrame, *columns: str) -> DataFrame:
    """(code, place, *columns) of every place of (codes, *columns), whole numbers all."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for codes, *others in rows_of(batches, "codes", *columns):
            each = [np.frombuffer(c or b"", "<u4") for c in codes]
            n = list(map(len, each))
            if sum(n):
                place = np.concatenate([np.arange(k) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).astype(np.int64)), pa.array(place), *(pa.array(np.repeat(np.array(o, np.int64), n)) for o in others)], ["code", "place", *columns])

    return prints.select("codes", *columns).mapInArrow(run, ", ".join(f"{c} long" for c in ("code", "place", *columns)))


def _in_cells(places: DataFrame, hot: DataFrame, mine: str, other: str, key: str) -> DataFrame:
    """Places with their cell (a, b): one for most integers; places of a frequent one lie in one of the parts of their own
    side, and are copied for those of the other."""
    found = places.join(hot, "code", "left")
    own = F.pmod(F.xxhash64(key, "place"), F.coalesce(mine, F.lit(1)).cast("long")).cast("int")
    return found.withColumn(mine, own).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)).cast("int") - 1)))


def search(classes: DataFrame, queries: DataFrame, split: int = SPLIT) -> DataFrame:
    """(class_id, match_id, votes, offset, bit_error), written: for each class of ``classes`` (rec_id, codes) all queries of
    ``queries`` (rec_id, class_id, codes) of another class that it matches at their best offset: that of most votes, of equal
    ones the smallest."""
    short_batches(classes.sparkSession)
    ones, others = written(_places(classes, "rec_id"), "class-places"), written(_places(queries, "rec_id", "class_id"), "query-places")
    sides = ones.groupBy("code").agg(F.count("*").alias("n")).join(others.groupBy("code").agg(F.count("*").alias("m")), "code")
    parts = lambda n: F.ceil(F.col(n) / split).cast("int")
    hot = written(sides.select("code", parts("n").alias("a"), parts("m").alias("b")).where("a > 1 or b > 1"), "frequent")
    left = _in_cells(ones, hot, "a", "b", "rec_id").select("code", "a", "b", F.col("rec_id").alias("one"), F.col("place").alias("p"))
    right = _in_cells(others, hot, "b", "a", "rec_id").select("code", "a", "b", F.col("rec_id").alias("other"), "class_id", F.col("place").alias("q"))
    equal = left.join(right, ["code", "a", "b"]).where("one <> class_id")
    votes = equal.groupBy("one", "other", (F.col("p") - F.col("q")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("one", "other").agg(F.max(F.struct("votes", (-F.col("offset")).alias("less"))).alias("b")).select("one", "other", "b.votes", (-F.col("b.less")).alias("offset"))
    # Short recordings need fewer votes than MIN_VOTES; the rest of the rule needs their codes.
    sized = lambda df, id_, n, c: df.select(F.col("rec_id").alias(id_), (F.length("codes") / 4).cast("int").alias(n), F.col("codes").alias(c))
    lengths = best.join(sized(classes, "one", "n", "x").select("one", "n"), "one").join(sized(queries, "other", "m", "y").select("other", "m"), "other")
    likely = lengths.where(F.col("votes") >= F.least(F.lit(MIN_VOTES), "n", "m")).select("one", "other", "votes", "offset")
    both = likely.join(sized(classes, "one", "n", "x").select("one", "x"), "one").join(sized(queries, "other", "m", "y").select("other", "y"), "other")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for one, other, votes, offset, x, y in rows_of(batches, "one", "other", "votes", "offset", "x", "y"):
            out = []
            for row in zip(one, other, votes, offset, x, y, strict=True):
                a, b = (np.frombuffer(v, "<u4") for v in row[4:])
                error = bit_error(a, b, row[3])
                if is_match(len(a), len(b), row[2], row[3], error):
                    out.append((*row[:4], error))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["class_id", "match_id", "votes", "offset", "bit_error"])

    return written(both.mapInArrow(run, "class_id long, match_id long, votes long, offset long, bit_error double"), "found")


def match_recordings(prints: DataFrame, is_query, split: int = SPLIT) -> DataFrame:
    """(rec_id, n_codes, class_id, n_matches, match_id, votes, offset, bit_error, matched) of every row of ``prints`` (rec_id,
    n_codes, codes): its class, the number of queries that the class matches, and of these the nearest (lowest bit error,
    then most votes, then smallest id). Every further query that a class matches has a row of its own, whose rec_id is the
    class_id, so that the links of a recording are those of its class.

    Of equal recordings the query with the smallest id stands for all. Recordings too short for a code, and null ones, are a
    class and match nothing; null ids are kept, in the class of their codes."""
    known = prints.where("n_codes > 0 and rec_id is not null")
    classes = written(known.groupBy("codes").agg(F.min("rec_id").alias("rec_id"), F.min(F.when(is_query(F.col("rec_id")), F.col("rec_id"))).alias("query"), F.min("n_codes").alias("n_codes")), "classes")
    with scratch(prints.sparkSession) as keep:
        found = search(classes.select("rec_id", "codes"), classes.where("query is not null").select(F.col("query").alias("rec_id"), F.col("rec_id").alias("class_id"), "codes"), split)
        keep(found)
    best = F.min_by(F.struct("match_id", "votes", "offset", "bit_error"), F.struct("bit_error", (-F.col("votes")).alias("less"), "match_id"))
    nearest = found.groupBy("class_id").agg(F.count("*").alias("n_matches"), best.alias("b")).select("class_id", "n_matches", "b.*")
    told = classes.select("codes", F.col("rec_id").alias("class_id")).join(nearest, "class_id", "left")
    rows = prints.join(told, "codes", "left")
    link = [F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "match_id", "votes", "offset", "bit_error", F.col("match_id").isNotNull().alias("matched")]
    first = rows.select("rec_id", "n_codes", F.when(F.col("n_codes") > 0, F.col("class_id")).otherwise(F.col("rec_id")).alias("class_id"), *link)
    more = found.join(nearest.select("class_id", "n_matches", F.col("match_id").alias("first")), "class_id").where("match_id <> first")
    further = more.join(classes.select(F.col("rec_id").alias("class_id"), "n_codes"), "class_id")
    return first.unionByName(further.select(F.col("class_id").alias("rec_id"), "n_codes", "class_id", *link))


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", melody, "embedding"), "prints")
    return match_recordings(prints, lambda rec_id: rec_id % 100 == 0)
