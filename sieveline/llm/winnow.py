"""Document fingerprints by winnowing, in DataFrame functions only.

A text is lower-cased and cut into terms: runs of letters and digits of any script, ideographs and kana one by one. Each
term is hashed once, and every ``K`` adjacent ones make a Karp-Rabin number, a polynomial in ``BASE`` modulo 2^31 - 1 (a text
with fewer terms is one gram; one without terms is its own gram). Of every ``WINDOW`` adjacent grams the smallest hash is chosen, the rightmost where several
are equal; the chosen grams, with the places of their first terms, are the fingerprint. Two texts that share
``WINDOW + K - 1`` adjacent terms share a chosen gram, and the places tell where. Equal texts have equal fingerprints; the
empty text has none.

The next document's text is found with one exchange of the texts: documents are dealt to ranges of doc_id of about
``PER_RANGE`` rows, however many these are; each range also gets the first document of the one after it, and a window over
the range looks one row ahead. Ranges are equal parts of intervals between at most ``COARSE`` quantiles, and an id that
fills several quantiles is cut by a hash of the text.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import scratch, table, text_or_empty, written

K, WINDOW = 3, 8
#: Of the Karp-Rabin numbers; both factors of a product stay below 2^31.
BASE, MODULUS = 1_000_003_579, (1 << 31) - 1
#: Rows of a range, quantiles that ranges start from, and ranges whose first keys are broadcast (24 bytes each).
PER_RANGE, COARSE, SENT = 250, 2_000, 100_000
_LOWEST = -(1 << 63)
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_BETWEEN = r"[^\p{L}\p{M}\p{N}]+"
_EACH = rf"[{_SINGLE}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_SINGLE}]]+"
_PLACE = (1 << 31) - 1


def terms(text: Column) -> Column:
    low = F.lower(text)
    single = (F.octet_length(low) - F.char_length(low) >= 2) & low.rlike(f"[{_SINGLE}]")  # such a character has three bytes
    return F.when(single, F.regexp_extract_all(low, F.lit(_EACH), F.lit(0))).otherwise(F.array_remove(F.split(low, _BETWEEN), ""))


def chosen(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<bigint> of the chosen grams in order of place: a 31-bit hash above, 2^31 - 1 less the place below.

    One number holds both, so that the least one of a window is the least hash and, among equals, the rightmost place.
    """
    if window & (window - 1):
        raise ValueError("window is a power of two")
    # What is used more than once is bound as a lambda's argument: it is computed once.
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def placed(hashed: Column) -> Column:
        """h[i] * BASE^(k-1) + ... + h[i+k-1] for every place, and the place; terms past the end count 0."""

        def number(first: Column, i: Column) -> Column:
            out = first
            for j in range(1, k):
                out = (out * F.lit(BASE) + F.coalesce(F.get(hashed, i + j), F.lit(0).cast("long"))) % F.lit(MODULUS)
            return F.shiftleft(out, 31).bitwiseOR((F.lit(_PLACE) - i).cast("long"))

        return F.transform(F.slice(hashed, 1, F.greatest(F.size(hashed) - (k - 1), F.lit(1))), number)

    def grams(words: Column) -> Column:
        alone = F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 33), 31).bitwiseOR(F.lit(_PLACE).cast("long")))
        each = F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 33))
        return F.when(F.size(words) > 0, bind(each, placed)).when(text != "", alone).otherwise(F.array().cast("array<bigint>"))

    def narrowed(least: Column, step: int) -> Column:
        """Minima of windows of twice the length; past the end the shorter array gives nulls, which least() skips."""
        return bind(least, lambda x: F.zip_with(x, F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0))), lambda a, b: F.least(a, b)))

    def windows(all_grams: Column) -> Column:
        least, step = all_grams, 1
        while step < window:
            least, step = narrowed(least, step), step * 2
        return F.array_distinct(F.slice(least, 1, F.greatest(F.size(all_grams) - (window - 1), F.lit(1))))

    return bind(bind(terms(text), grams), windows)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, 31)))


def places(fingerprint: Column) -> Column:
    """Places of the chosen grams' first terms."""
    return F.transform(fingerprint, lambda x: (F.lit(_PLACE) - x.bitwiseAND(F.lit(_PLACE).cast("long"))).cast("int"))


def written_out(hashed: Column) -> Column:
    return F.array_join(F.transform(hashed, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two sets of hashes, from 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, fingerprint array<bigint> of hashes, places array<int>) of every whole text; no exchange."""
    found = docs.select("doc_id", text_or_empty().alias("text")).withColumn("chosen", chosen(F.col("text"), k, window))
    return found.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.transform("chosen", lambda x: F.shiftrightunsigned(x, 31)).alias("fingerprint"), places(F.col("chosen")).alias("places"))


def with_places(fingerprint: Column) -> Column:
    """hash:place of each chosen gram, in order of place."""
    hashed = F.transform(fingerprint, lambda x: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 31))), 8, "0"), F.lit(":"), (F.lit(_PLACE) - x.bitwiseAND(F.lit(_PLACE).cast("long"))).cast("string")))
    return F.array_join(hashed, ",")


class Ranges(NamedTuple):
    """Distinct quantiles ``start`` (the first is the least key), how many quantiles fell on each (``times``), the number of
    the first range from there on (``first``), and the equal parts of each interval."""

    start: list[int]
    times: list[int]
    first: list[int]
    parts: int
    end: int


def ranges(keys: DataFrame, per_range: int = PER_RANGE, coarse: int = COARSE) -> Ranges:
    """Ranges of about ``per_range`` rows of ``keys`` (k); at most ``coarse`` numbers reach the driver."""
    rows, least, most = keys.agg(F.count("*"), F.min("k"), F.max("k")).first()
    if not rows:
        return Ranges([0], [1], [0], 1, 1)
    n = min(-(-rows // per_range), coarse)
    parts = -(-rows // (n * per_range))
    found = keys.agg(F.percentile_approx("k", [i / n for i in range(1, n)], F.lit(max(10_000, 20 * n))).alias("q")).first()["q"] if n > 1 else []
    start, times = [least], [1]
    for q in sorted(found):
        if q == start[-1]:
            times[-1] += 1
        else:
            start.append(q)
            times.append(1)
    first = [0]
    for m in times[:-1]:
        first.append(first[-1] + (m * parts if m > 1 else 0) + parts)
    return Ranges(start, times, first, parts, most + 1)


def range_of(k: Column, h: Column, r: Ranges) -> tuple[Column, Column]:
    """(interval, range) of a row: its interval by two short searches, its part by where it lies there. Both grow with (k, h)."""
    step = max(1, math.isqrt(len(r.start)))
    array = lambda xs, kind="long": F.array(*[F.lit(float(x) if kind == "double" else x).cast(kind) for x in xs])
    blocks = [r.start[i : i + step] for i in range(0, len(r.start), step)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= k))
    outer = F.greatest(below(array([b[0] for b in blocks])) - 1, F.lit(0))
    at = F.greatest(outer * step + below(F.get(F.array(*map(array, blocks)), outer)) - 1, F.lit(0))

    def number(i: Column) -> Column:
        lo, hi = F.get(array(r.start, "double"), i), F.get(array([*r.start[1:], r.end], "double"), i)
        times, first = F.get(array(r.times), i), F.get(array(r.first), i)
        clipped = lambda x, n: F.least(F.greatest(F.floor(x), F.lit(0)), n - 1)
        part = clipped((k.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * r.parts, F.lit(r.parts))
        by_text = clipped((h.cast("double") / 2.0**64 + 0.5) * times * r.parts, times * r.parts)
        return F.when((times > 1) & (k == F.get(array(r.start), i)), first + by_text).otherwise(first + F.when(times > 1, times * r.parts).otherwise(F.lit(0)) + part)

    return at, F.element_at(F.transform(F.array(at), number), 1)


def _before(keys: DataFrame) -> DataFrame:
    """(k, h, before) of the first key of every range, with the range before it, written; the first of all has the last.

    Ranges are looked at interval by interval, and of each interval one row meets the others."""
    firsts = written(keys.groupBy("at", "range").agg(F.min(F.struct("k", "h")).alias("key")), "firsts")
    ends = firsts.groupBy("at").agg(F.max("range").alias("last"))
    ends = ends.select(F.col("at").alias("of"), F.coalesce(F.lag("last").over(Window.orderBy("at")), F.max("last").over(Window.partitionBy())).alias("earlier"))
    inner = firsts.select("at", "key", F.lag("range").over(Window.partitionBy("at").orderBy("range")).alias("before"))
    found = inner.join(ends, F.col("at") == F.col("of")).select("key.k", "key.h", F.coalesce("before", "earlier").alias("before"))
    return written(found, "before")


def edited_documents(docs: DataFrame, per_range: int = PER_RANGE, k: int = K, window: int = WINDOW, coarse: int = COARSE) -> DataFrame:
    """Each document against its edited text (its second half replaced by the start of the next one) and the next document.

    Equal doc_ids follow each other in the order of a hash of their texts, null ids stand with the least, the last document
    is followed by the first. Rows that are equal in id and text lie in one range. Empty input gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    slim = slim.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LOWEST)).alias("k"), F.xxhash64("text").alias("h"))
    with scratch(docs.sparkSession) as keep:
        keys = written(slim.select("k", "h"), "keys")
        plan = ranges(keys, per_range, coarse)
        at, number = range_of(F.col("k"), F.col("h"), plan)
        before = _before(keys.select("k", "h", at.alias("at"), number.alias("range")))
        keep(before)
    if before.count() <= SENT:
        before = F.broadcast(before)
    # Rows that repeat a first key have its text too.
    halo = slim.join(before, ["k", "h"]).groupBy(F.col("before").alias("range")).agg(F.min("k").alias("k"), F.min("h").alias("h"), F.min("text").alias("text"))
    both = slim.withColumns({"range": number, "halo": F.lit(0)}).unionByName(halo.withColumns({"doc_id": F.lit(None).cast("long"), "halo": F.lit(1)}))
    ahead = Window.partitionBy("range").orderBy("halo", "k", "h")
    n, half = F.char_length("text"), F.expr("char_length(text) div 2").cast("int")
    rows = both.select("*", F.lead("text").over(ahead).alias("next"), F.row_number().over(ahead).alias("place"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("range", "halo", "place", "doc_id", "text", n.cast("long").alias("n_chars"), F.when(F.col("halo") == 0, edited).alias("edited"))
    rows = rows.select(
        "range", "halo", "place", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        chosen(F.col("text"), k, window).alias("grams"), hashes(chosen(F.col("edited"), k, window)).alias("other"),
    ).withColumn("own", hashes(F.col("grams")))
    rows = rows.withColumn("following", F.lead("own").over(Window.partitionBy("range").orderBy("place"))).where("halo = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written_out(F.col("own")).alias("fingerprint"), written_out(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), with_places(F.col("grams")).alias("places"),
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_documents(table(spark, sf_dir, "documents"))
