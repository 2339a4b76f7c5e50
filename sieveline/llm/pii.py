"""Personal data: base patterns, and what bootstrapped contexts add to them. DataFrame functions only.

Every whole text is searched once for emails, IP addresses, cards and phones. These seeds induce lexical patterns: the two
words before a seed, and the word before with the word after. Other tokens that hold digits are instances too if they
stand in such a pattern. Patterns and instances form a graph that is scored in turns:

* an instance has a kind and a confidence, 1 for seeds;
* a pattern scores, for each kind, the mean confidence of its distinct instances, damped where few support it, and takes the
  kind that scores best (the first of equal ones). It needs ``SUPPORT`` instances of that kind that are seeds or accepted;
* an instance that is no seed has the score of its best pattern, and is accepted from ``CONFIDENT`` on.

What is accepted in one turn counts like a seed in the next, so that it induces patterns in which no seed stands. After
``ROUNDS`` turns tokens in patterns that score ``CONFIDENT`` or more are reported with the pattern's kind. What the base
rules looked at and rejected is never reported.

A token is a whole run of ASCII letters, digits, dots, hyphens and underscores, trimmed of marks at its ends, with a digit
and ``SHORTEST`` characters at least, however long it is. Words of a context are looked for within ``REACH`` characters.
Texts do not move. Values and patterns are 64-bit hashes in a slim table that is written once; edges are combined before
they are exchanged, so that a pattern in a third of all rows is a few rows for each task.

Null texts count as empty and have no spans; repeated rows are reported as often as they come, null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import scratch, table, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances that a pattern needs, turns of scoring, and the score from which a pattern is trusted.
SUPPORT, ROUNDS, CONFIDENT = 4, 3, 0.75
#: Code points looked at on either side of a span; code points of the shortest token.
REACH, SHORTEST = 40, 6

#: Stands for one separator within a match, so that matches are plain runs: a repeated group would recurse for each of
#: its repetitions, and scan long runs from each of their characters.
_MARK = "\ue000"
_LOCAL = rf"A-Za-z0-9._%+{_MARK}-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_CARD = rf"(?<![0-9{_MARK}])(?=(?:[0-9]{_MARK}?){{12}})[0-9{_MARK}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<![A-Za-z0-9._-])(?=[A-Za-z._-]*+[0-9])[A-Za-z0-9._-]++"


def _bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once though used more than once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _marked(text: Column, separator: str, around: str) -> Column:
    return F.regexp_replace(F.translate(text, _MARK, "x"), rf"(?<={around}){separator}(?={around})", _MARK)


def _running(sizes: Column, first: Column) -> Column:
    """``first`` and the sums up to each size but the last: where each part starts."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _starts(sizes: Column) -> Column:
    """``_running`` from 0 of a long array, in parts of about its square root: an array that grows is copied each time."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, n: s + n)

    def by_parts(xs: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), step), lambda i: F.slice(xs, i + 1, step))
        return _bind(parts, lambda ps: F.flatten(F.zip_with(ps, _running(F.transform(ps, total), F.lit(0)), _running)))

    return _bind(sizes, by_parts)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, value string>> of the leftmost matches that do not overlap, in code points."""

    def place(between: Column, found: Column) -> Column:
        # The text is between[0] found[0] between[1] found[1] ...; sums of lengths are positions.
        pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("n"), m.alias("m")))
        at = lambda p, start: F.struct((start + p["gap"]).alias("start"), (start + p["gap"] + p["n"]).alias("end"), p["m"].alias("value"))
        return _bind(pairs, lambda ps: F.zip_with(ps, _starts(F.transform(ps, lambda p: p["gap"] + p["n"])), at))

    return _bind(text, lambda t: _bind(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(F.split(t, pattern, -1), found)).otherwise(_none())))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def _found(text: Column) -> Column:
    """array<struct<kind int, start int, end int, value string, sound boolean>>: base matches, sound or rejected."""
    length = lambda v: F.char_length(_digits(v))
    digit_run = text.rlike(r"[0-9](?:[ -]?[0-9]){11}")
    parts = (
        (text.contains("@"), _marked(text, r"\.", "[A-Za-z0-9-]"), _EMAIL, lambda v: F.lit(True)),
        (text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), text, _IP, lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        (digit_run, _marked(text, "[ -]", "[0-9]"), _CARD, lambda v: length(v).between(12, 19) & F.when(length(v).between(12, 19), luhn(_digits(v))).otherwise(False)),
        (text.rlike(r"\+[0-9]"), text, _PHONE, lambda v: length(v).between(9, 15)),
    )

    def judged(kind: int, sound):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), sound(m["value"]).alias("sound"))

    out = []
    for kind, (needed, searched, pattern, sound) in enumerate(parts):
        found = F.when(needed, matches(searched, pattern)).otherwise(_none())
        out.append(F.transform(found, judged(kind, sound)))
    return F.concat(*out)


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """The patterns that a span stands in; words are lower-cased, digits left out."""
    words = lambda part: F.array_remove(F.split(F.lower(part), r"[^\p{L}\p{M}:=#@]+"), "")
    left = words(F.substr(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH))))
    right = words(F.substr(text, end + 1, F.lit(REACH)))
    one = lambda ws, back: F.coalesce(F.get(ws, F.size(ws) - back), F.lit("^"))
    return F.array(
        F.concat_ws(" ", one(left, 2), one(left, 1), F.lit("_")),
        F.concat_ws(" ", one(left, 1), F.lit("_"), F.coalesce(F.get(right, F.lit(0)), F.lit("$"))),
    )


def _tokens(text: Column) -> Column:
    """The tokens that may be identifiers, trimmed."""

    def trimmed(m: Column) -> Column:
        lead = F.char_length(m["value"]) - F.char_length(F.ltrim(m["value"], F.lit("._-")))
        value = F.btrim(m["value"], F.lit("._-"))
        return F.struct((m["start"] + lead).alias("start"), (m["start"] + lead + F.char_length(value)).alias("end"), value.alias("value"))

    return F.filter(F.transform(matches(text, _TOKEN), trimmed), lambda m: F.char_length(m["value"]) >= SHORTEST)


def positions(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, base array<struct<start, kind, end>>, seen array<struct<kind, start, end, value, patterns>>), written.

    ``seen`` has the seeds, and with kind null the other tokens that hold digits; values and patterns are hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("found", F.when(F.col("text").rlike("[0-9@]"), _found(F.col("text"))).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,value:string,sound:boolean>>")))
    tokens = F.when(F.col("text").rlike("[0-9]"), _tokens(F.col("text"))).otherwise(_none())
    apart = lambda m: ~F.exists("found", lambda f: (f["start"] < m["end"]) & (m["start"] < f["end"]))

    def instance(m: Column, kind: Column) -> Column:
        around = F.transform(_contexts(F.col("text"), m["start"], m["end"]), lambda c: F.xxhash64(c))
        return F.struct(kind.cast("int").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(F.lower(m["value"])).alias("value"), around.alias("patterns"))

    sound = F.filter("found", lambda f: f["sound"])
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.xxhash64("text").alias("digest"),
        F.array_sort(F.transform(sound, lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end")))).alias("base"),
        F.concat(F.transform(sound, lambda f: instance(f, f["kind"])), F.transform(F.filter(tokens, apart), lambda m: instance(m, F.lit(None)))).alias("seen"),
    )
    return written(rows, "positions")


def _scored_patterns(edges: DataFrame, accepted: DataFrame | None, support: int, confident: float) -> DataFrame:
    """(pattern, of, score) of the patterns with enough support, of their best kind. One exchange of combined rows."""
    known = edges.select("pattern", "kind", F.when(F.col("kind").isNotNull(), 1.0).alias("score")) if accepted is None else edges.join(accepted, "value", "left").select(
        "pattern", F.coalesce("kind", "as").alias("kind"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("score")
    )
    of = lambda k: F.col("kind") == k
    sums = [F.sum(F.when(of(k), F.col("score"))).alias(f"sum{k}") for k in range(len(KINDS))]
    counts = [F.count_if(of(k) & (F.col("score") >= confident)).alias(f"n{k}") for k in range(len(KINDS))]
    pattern = known.groupBy("pattern").agg(F.count("*").alias("all"), *sums, *counts)
    # Kinds in order, each with its score, null without support: the greatest score, and of equal ones the first kind.
    each = [F.struct(F.when(F.col(f"n{k}") >= support, F.col(f"sum{k}") / F.col("all") * (1 - 1 / (F.col(f"n{k}") + 1))).alias("score"), F.lit(-k).alias("less")) for k in range(len(KINDS))]
    best = F.array_max(F.array(*each))
    return pattern.select("pattern", best.alias("b")).where("b.score is not null").select("pattern", (-F.col("b.less")).alias("of"), F.col("b.score").alias("score"))


def trusted_patterns(seen: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind, score) of the patterns that are trusted, written. ``seen``: (pattern, value, kind), kind null for no seed."""
    if rounds < 1:
        raise ValueError("at least one round")
    with scratch(seen.sparkSession) as keep:
        edges = written(seen.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "edges")
        accepted = None
        for turn in range(rounds):
            patterns = _scored_patterns(edges, accepted, support, confident)
            if turn < rounds - 1:
                reached = edges.where("kind is null").join(patterns, "pattern").groupBy("value").agg(F.max(F.struct("score", (-F.col("of")).alias("less"))).alias("b"))
                accepted = written(reached.where(F.col("b.score") >= confident).select("value", (-F.col("b.less")).alias("as"), F.col("b.score").alias("confidence")), "accepted")
        trusted = written(patterns.where(F.col("score") >= confident).select("pattern", F.col("of").alias("kind"), "score"), "trusted")
        keep(trusted)
    return trusted


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, base, every) for every row of ``docs`` (doc_id, text): arrays of (start, kind, end), sorted."""
    rows = positions(docs)
    seen = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    trusted = trusted_patterns(seen.select("pattern", "value", "kind")).select("pattern", F.col("kind").alias("of"), "score")
    hits = seen.where("kind is null").join(trusted, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("score", (-F.col("of")).alias("less"))).alias("b"))
    more = hits.groupBy("row").agg(F.collect_list(F.struct("start", (-F.col("b.less")).alias("kind"), "end")).alias("more"))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.select("row", "doc_id", "digest", "base").join(more, "row", "left").select("doc_id", "digest", "base", every.alias("every"))


def find(docs: DataFrame) -> DataFrame:
    """The query's columns for every row of ``docs`` (doc_id, text)."""
    name = lambda kind: F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return spans(docs).select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans")
    )


def _replaced(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap are one, named by the first."""
    name = lambda kind: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), kind + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), name(s["kind"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.lit(2147483647) - acc["at"] - 1)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced; all columns and rows stay, null texts stay null."""
    found = spans(docs).where(F.size("every") > 0).groupBy("doc_id", "digest").agg(F.first("every").alias("every"))
    found = found.select(F.col("doc_id").alias("span_doc_id"), "digest", "every")
    joined = docs.select(F.struct("*").alias("d"), F.xxhash64(text_or_empty()).alias("h")).join(found, F.col("d.doc_id").cast("long").eqNullSafe(F.col("span_doc_id")) & (F.col("h") == F.col("digest")), "left")
    done = joined.withColumn("d", F.when(F.col("every").isNotNull(), F.col("d").withField("text", _replaced(F.col("d.text"), F.col("every")))).otherwise(F.col("d")))
    return done.select("d.*")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
