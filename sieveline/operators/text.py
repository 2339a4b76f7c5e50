"""BM25F full-text search.

An index is two tables: postings (term, doc_id, exact array<int>, stemmed array<int>, and beside them the document's
field_length, where it is known) and lengths (doc_id, field_length).
``TextIndex.of`` makes them from documents; a search then asks for the terms it wants, and tokens that no query term
matches are left out within each row, before anything is exploded or exchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import scoring as S
from sieveline.functions.postings import by_term
from sieveline.operators.ids import only, without
from sieveline.schema import MAX_FIELD_LENGTH

#: min_match counts the matches of the first MASKED tokens of a query only.
MASKED = 32


def tokens(text: Column) -> Column:
    """Lower-cased, split on white space, empty ones left out."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


@dataclass(frozen=True)
class Search:
    """``tolerance``: 0 whole terms, None prefixes, n terms within n edits."""

    tokens: tuple[str, ...]
    tolerance: int | None = 0
    exact_match: bool = False
    boost: float = 1.0
    phrase_boost: float = 0.0
    min_match: int = 0
    k: float = S.K
    b: float = S.B
    exact_boost: float = S.EXACT_BOOST

    def matches(self, term: Column, token: str) -> Column:
        if self.tolerance is None:
            return F.startswith(term, F.lit(token))
        if self.tolerance == 0:
            return term == token
        near = F.abs(F.char_length(term) - F.lit(len(token))) <= self.tolerance
        return near & (F.levenshtein(term, F.lit(token), self.tolerance) >= 0)


@dataclass(frozen=True)
class TextIndex:
    """``postings_where`` gives the postings whose term meets a condition; ``lengths`` has all documents. ``terms`` (term) has
    the distinct terms of a stored index, which fuzzy searches look at instead of all postings; ``known_stats``
    is its (n_docs, n_tokens) where nothing hides a document. ``whole`` gives all postings of documents, and if asked for a row
    without a term for each document that has none."""

    postings_where: Callable[[Callable[[Column], Column]], DataFrame]
    lengths: DataFrame
    removed: DataFrame | None = field(default=None)
    terms: DataFrame | None = field(default=None)
    known_stats: tuple[int, int] | None = field(default=None)
    whole: Callable[[bool], DataFrame] | None = field(default=None)

    @staticmethod
    def of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: Callable[[Column], Column] = tokens, stemmer: Callable[[Column], Column] | None = None) -> TextIndex:
        """An index over documents that is computed when asked for. Null texts are not indexed. A stem stands beside its
        token, so that both are found at the same place; a token whose stem is null has none."""
        rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), tokenizer(F.col(text)).alias("tokens"))
        length = F.least(F.size("tokens"), F.lit(MAX_FIELD_LENGTH)).alias("field_length")

        def postings(condition: Callable[[Column], Column]) -> DataFrame:
            placed = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"), F.lit(False).alias("stem")))
            if stemmer is not None:
                stems = F.transform("tokens", lambda t, i: F.struct(stemmer(t).alias("term"), i.alias("pos"), F.lit(True).alias("stem")))
                placed = F.concat(placed, stems)
            hits = rows.select("doc_id", length, F.explode(F.filter(placed, lambda p: p["term"].isNotNull() & condition(p["term"]))).alias("p")).select("doc_id", "field_length", "p.*")
            place = lambda stem: F.sort_array(F.collect_list(F.when(F.col("stem") == stem, F.col("pos"))))
            return hits.groupBy("term", "doc_id").agg(place(False).alias("exact"), place(True).alias("stemmed"), F.max("field_length").alias("field_length"))

        def whole(empty: bool) -> DataFrame:
            met = rows.groupBy("doc_id").agg(F.collect_list("tokens").alias("texts"), F.max(length).alias("field_length"))
            return _by_term(met, stemmer, empty)

        return TextIndex(postings, rows.select("doc_id", length), whole=whole)

    @staticmethod
    def stored(postings: DataFrame, lengths: DataFrame, removed: DataFrame | None = None, terms: DataFrame | None = None, known_stats: tuple[int, int] | None = None) -> TextIndex:
        """An index read from tables; conditions on terms reach the scan. Postings may have a column field_length, which saves
        the join with ``lengths``."""
        found = lambda condition: without(postings.where(condition(F.col("term"))), removed)
        return TextIndex(found, without(lengths, removed), removed, terms, None if removed is not None else known_stats)

    def postings(self) -> DataFrame:
        return self.whole(False) if self.whole else self.postings_where(lambda term: F.lit(True))

    def stats(self) -> DataFrame:
        """One row: documents, tokens, average length."""
        if self.known_stats is not None:
            n_docs, n_tokens = self.known_stats
            return self.lengths.sparkSession.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(n_tokens).cast("long").alias("n_tokens"), F.lit(n_tokens / n_docs if n_docs else 0.0).alias("avg_length"))
        total = F.coalesce(F.sum(F.col("field_length").cast("long")), F.lit(0).cast("long"))
        return self.lengths.agg(F.count("*").alias("n_docs"), total.alias("n_tokens")).withColumn("avg_length", F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.nullif("n_docs", F.lit(0))).otherwise(0.0))


def _by_term(docs: DataFrame, stemmer: Callable[[Column], Column] | None, empty: bool) -> DataFrame:
    """Postings of (doc_id, texts, field_length), a row for each document with the tokens of its rows. All tokens of a document
    are in its row, so that no single token is exchanged."""
    stems = [] if stemmer is None else [F.transform("texts", lambda ts: F.transform(ts, stemmer)).alias("stems")]
    places = T.ArrayType(T.IntegerType())
    schema = T.StructType().add("term", T.StringType()).add("doc_id", docs.schema["doc_id"].dataType).add("exact", places).add("stemmed", places).add("field_length", T.IntegerType())
    return docs.select("doc_id", "field_length", "texts", *stems).mapInArrow(lambda batches: by_term(batches, empty), schema)


def matched(index: TextIndex, search: Search, allowed: DataFrame | None = None) -> DataFrame:
    """(token_idx, term, is_exact, doc_id, exact, stemmed): every posting that a token of the query matches, once for each."""
    wanted = list(dict.fromkeys(search.tokens))
    if not wanted:
        rows = index.postings_where(lambda term: F.lit(False))
        return rows.select(F.lit(0).alias("token_idx"), "term", F.lit(True).alias("is_exact"), "doc_id", "exact", "stemmed")

    def any_of(term: Column) -> Column:
        if search.tolerance == 0:
            return term.isin(wanted)
        one, *rest = [search.matches(term, t) for t in wanted]
        for r in rest:
            one = one | r
        return one

    if not search.tolerance or index.terms is None:  # whole terms and prefixes reach the scan
        rows = only(index.postings_where(any_of), allowed)
    else:  # each distinct term is compared once; Spark broadcasts the terms found if they are few
        rows = index.postings_where(lambda term: F.lit(True)).join(index.terms.where(any_of(F.col("term"))).select("term").distinct(), "term", "left_semi")
        rows = only(rows, allowed)
    each = F.array(*[F.when(search.matches(F.col("term"), t), F.lit(i)) for i, t in enumerate(search.tokens)])
    rows = rows.withColumn("token_idx", F.explode(F.filter(each, lambda i: i.isNotNull())))
    token = F.element_at(F.array(*map(F.lit, search.tokens)), F.col("token_idx") + 1)
    length = ["field_length"] if "field_length" in rows.columns else []
    return rows.select("token_idx", "term", (F.col("term") == token).alias("is_exact"), "doc_id", "exact", "stemmed", *length)


def document_frequency(rows: DataFrame) -> DataFrame:
    """(token_idx, df): matching postings, those without a usable place included."""
    return rows.groupBy("token_idx").agg(F.count("*").alias("df"))


def contributions(index: TextIndex, search: Search, allowed: DataFrame | None = None) -> DataFrame:
    """(token_idx, doc_id, ntf): the sum over matching terms, before idf and saturation."""
    return _contributions(matched(index, search, allowed), index, search)


def _weighed(rows: DataFrame, index: TextIndex, search: Search) -> DataFrame:
    """``rows`` with the posting's ntf, null where it has no usable place, and with n_docs."""
    tf = F.size("exact") if search.exact_match else F.size("exact") + F.size("stemmed")
    rows = rows if "field_length" in rows.columns else rows.join(index.lengths, "doc_id", "left")
    rows = rows.withColumn("tf", tf).crossJoin(F.broadcast(index.stats()))  # one row
    ntf = S.normalised_tf(F.col("tf"), F.coalesce("field_length", F.lit(0)), F.col("avg_length"), search.b)
    ntf = ntf * F.lit(search.boost) * F.when(F.col("is_exact"), F.lit(search.exact_boost)).otherwise(F.lit(1.0))
    return rows.withColumn("ntf", F.when(F.col("tf") > 0, ntf))


def _contributions(rows: DataFrame, index: TextIndex, search: Search) -> DataFrame:
    return _weighed(rows, index, search).where("ntf is not null").groupBy("token_idx", "doc_id").agg(F.sum("ntf").alias("ntf"))


def scored(parts: DataFrame, frequency: DataFrame, stats: DataFrame, search: Search) -> DataFrame:
    """(doc_id, score) from contributions, df and corpus statistics; the latter two have a row for each token, and one."""
    return _scored(parts.crossJoin(F.broadcast(stats.select("n_docs"))), frequency, search)


def _scored(parts: DataFrame, frequency: DataFrame, search: Search, phrase: bool = False) -> DataFrame:
    rows = parts.join(F.broadcast(frequency), "token_idx")  # a row for each token
    score = S.saturated(S.idf(F.col("n_docs"), F.col("df")), F.col("ntf"), search.k)
    if phrase:
        first = F.filter("tokens", lambda t: t["token_idx"] < MASKED)  # a token is there once
        out = rows.groupBy("doc_id").agg(F.sum(score).alias("score"), F.collect_list(F.struct("token_idx", "places")).alias("tokens"))
        boosted = F.col("score") * S.phrase_multiplier(_adjacent(F.map_from_entries("tokens"), search), search.phrase_boost)
        out = out.select("doc_id", boosted.alias("score"), F.size(first).alias("matched"))
    else:
        matched_tokens = F.count_distinct(F.when(F.col("token_idx") < MASKED, F.col("token_idx")))
        out = rows.groupBy("doc_id").agg(F.sum(score).alias("score"), matched_tokens.alias("matched"))
    return out.where(F.col("matched") >= search.min_match).select("doc_id", "score") if search.min_match > 0 else out.select("doc_id", "score")


def adjacent_pairs(rows: DataFrame, search: Search) -> DataFrame:
    """(doc_id, adjacent): how many consecutive tokens of the query stand next to each other somewhere in the document."""
    by_token = rows.groupBy("doc_id", "token_idx").agg(_places(search).alias("places"))
    by_doc = by_token.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token_idx", "places"))).alias("m"))
    return by_doc.select("doc_id", _adjacent(F.col("m"), search).alias("adjacent"))


def _places(search: Search) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(F.col("exact") if search.exact_match else F.concat("exact", "stemmed"))))


def _adjacent(places: Column, search: Search) -> Column:
    """Of a map from tokens to their places."""
    at = lambda i: F.try_element_at(places, F.lit(i))
    count = F.lit(0)
    for i in range(1, len(search.tokens)):
        meets = F.arrays_overlap(F.transform(at(i - 1), lambda p: p + 1), at(i))
        count = count + F.coalesce(meets, F.lit(False)).cast("int")
    return count


def _told(rows: DataFrame, numbers: dict[str, Column], places: Column | None = None) -> DataFrame:
    """(token_idx, doc_id, told): what scores, frequencies and phrases need of a token's matches in a document.

    All is one map, so that each of them asks for the same aggregate, which Spark then computes once (a reused exchange):
    single columns would be pruned, and the index be read for each.
    """
    parts = rows.groupBy("token_idx", "doc_id").agg(*[c.cast("double").alias(name) for name, c in numbers.items()], *([] if places is None else [places.alias("places")]))
    values = [F.array(name) for name in numbers] + ([] if places is None else [F.col("places").cast("array<double>")])
    names = [*numbers, *([] if places is None else ["places"])]
    return parts.select("token_idx", "doc_id", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values)).alias("told"))


def _number(name: str) -> Column:
    return F.element_at(F.element_at("told", F.lit(name)), 1)


def search(index: TextIndex, request: Search, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of all documents that match."""
    phrase = request.phrase_boost > 0 and len(request.tokens) >= 2
    rows = _weighed(matched(index, request, allowed), index, request)
    gathered = _told(rows, {"ntf": F.sum("ntf"), "df": F.count("*"), "n_docs": F.max("n_docs")}, _places(request) if phrase else None)
    places = [F.element_at("told", F.lit("places")).alias("places")] if phrase else []
    parts = gathered.select("token_idx", "doc_id", _number("ntf").alias("ntf"), _number("n_docs").alias("n_docs"), *places).where("ntf is not null")
    return _scored(parts, gathered.groupBy("token_idx").agg(F.sum(_number("df")).alias("df")), request, phrase)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """Best first, ties by doc_id."""
    return found.orderBy(F.col("score").desc(), "doc_id").limit(k)


def bm25f(fields: list[tuple[TextIndex, Search, float]], documents: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) over several weighted fields: contributions of a token add up over fields before saturation; df counts
    the documents in which any field matched; ``documents`` (doc_id) gives N."""
    rows = None
    for index, request, weight in fields:
        part = _weighed(matched(index, request, allowed), index, request).select("token_idx", "doc_id", (F.col("ntf") * F.lit(float(weight))).alias("ntf"))
        rows = part if rows is None else rows.unionByName(part)
    gathered = _told(rows, {"ntf": F.sum("ntf"), "df": F.lit(1.0)})
    parts = gathered.select("token_idx", "doc_id", _number("ntf").alias("ntf")).where("ntf is not null")
    return scored(parts, gathered.groupBy("token_idx").agg(F.sum(_number("df")).alias("df")), documents.agg(F.count("*").alias("n_docs")), fields[0][1])


def multiply_scores(found: DataFrame, factors: DataFrame) -> DataFrame:
    """Scores times the factor (doc_id, factor) of the document, where it has one."""
    return found.join(factors, "doc_id", "left").select("doc_id", (F.col("score") * F.coalesce("factor", F.lit(1.0))).alias("score"))
