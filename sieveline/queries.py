"""Queries of every field operator over the driver's tables, each with the DuckDB SQL that gives the same rows.

All work on whole tables and leave the physical plan to Spark. Scores and distances are rounded, as the two engines add in
different orders; top-k queries carry their rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions import geo as G
from sieveline.operators import boolean, geo, ids, keys, number, text, vector
from sieveline.operators.ann import AnnIndex
from sieveline.operators.ranks import with_rank
from sieveline.plans.index import FieldIndex
from sieveline.schema import FieldSpec
from sieveline.sources import ingest
from sieveline.sources.oplog import hidden, live_view, visible
from sieveline.sources.work import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- boolean fields: whether an order is finished; whether any of its lines has a large discount


def _finished(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") == "F").alias("value"))


def _discounts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_discount") > 0.05).alias("value"))


_FINISHED = "SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS value FROM orders"
for _name, _value in (("bool_filter_true", True), ("bool_filter_false", False)):
    query(_name, f"SELECT DISTINCT doc_id FROM ({_FINISHED}) WHERE value = {str(_value).lower()}")(lambda s, d, v=_value: boolean.bool_filter(_finished(s, d), v))
# The check compares sets of rows: sorted results carry their rank.
query("bool_filter_desc", f"SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM (SELECT DISTINCT doc_id FROM ({_FINISHED}) WHERE value)")(lambda s, d: with_rank(boolean.bool_filter(_finished(s, d), True), F.col("doc_id").desc()))
query("bool_sort_asc", f"SELECT doc_id, value, row_number() OVER (ORDER BY value, doc_id) AS rank FROM (SELECT DISTINCT doc_id, value FROM ({_FINISHED}))")(
    lambda s, d: with_rank(boolean.bool_sort(_finished(s, d)), *boolean.sort_order())
)
query("bool_sort_desc", f"SELECT doc_id, value, row_number() OVER (ORDER BY value DESC, doc_id DESC) AS rank FROM (SELECT DISTINCT doc_id, value FROM ({_FINISHED}))")(
    lambda s, d: with_rank(boolean.bool_sort(_finished(s, d), True), *boolean.sort_order(True))
)
query("bool_array_filter", "SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_discount > 0.05")(lambda s, d: boolean.bool_filter(_discounts(s, d), True))


# -- number fields


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("long").alias("value"))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("value"))


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("value"))


_SIZES = "SELECT p_partkey AS doc_id, CAST(p_size AS BIGINT) AS value FROM part"
for _op, _sign in (("eq", "="), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    query(f"num_{_op}", f"SELECT DISTINCT doc_id, value FROM ({_SIZES}) WHERE value {_sign} 25")(lambda s, d, op=_op: number.number_filter(_sizes(s, d), op, 25))
query("num_between", f"SELECT DISTINCT doc_id, value FROM ({_SIZES}) WHERE value BETWEEN 10 AND 20")(lambda s, d: number.number_filter(_sizes(s, d), "between", 10, 20))
query("num_f64_between", "SELECT DISTINCT o_orderkey AS doc_id, o_totalprice AS value FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")(
    lambda s, d: number.number_filter(_prices(s, d), "between", 100000.0, 200000.0)
)
query("num_array_filter", "SELECT DISTINCT l_orderkey AS doc_id, l_quantity AS value FROM lineitem WHERE l_quantity >= 45")(lambda s, d: number.number_filter(_quantities(s, d), "gte", 45.0))
_BALANCES = "SELECT c_custkey AS doc_id, c_acctbal AS value FROM customer"


def _balances(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("value"))


query("num_sort_asc", f"SELECT *, row_number() OVER (ORDER BY value, doc_id) AS rank FROM ({_BALANCES})")(lambda s, d: with_rank(number.number_sort(_balances(s, d)), *number.sort_order(_balances(s, d))))
query("num_sort_desc", f"SELECT *, row_number() OVER (ORDER BY value DESC, doc_id DESC) AS rank FROM ({_BALANCES})")(
    lambda s, d: with_rank(number.number_sort(_balances(s, d), True), *number.sort_order(_balances(s, d), True))
)
for _down, _name in ((False, "num_sort_grouped"), (True, "num_sort_grouped_desc")):
    _way = "DESC" if _down else "ASC"
    query(_name, f"SELECT value, array_to_string(list_sort(list(DISTINCT doc_id), '{_way}'), ',') AS doc_ids, row_number() OVER (ORDER BY value {_way}) AS rank FROM ({_SIZES}) GROUP BY value")(
        lambda s, d, down=_down: with_rank(number.number_sort_grouped(_sizes(s, d), down), F.col("value").desc() if down else F.col("value")).select("value", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"), "rank")
    )
query("num_json_props", "SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")(
    lambda s, d: number.number_filter(
        ingest.number_entries(_t(s, d, "events").select(F.col("event_id").alias("doc_id"), F.get_json_object("props", "$.k").alias("json")), number="long"), "gte", 50
    )
)


# -- keys

query("key_filter", "SELECT DISTINCT doc_id FROM documents WHERE source = 'src3'")(lambda s, d: keys.key_filter(_t(s, d, "documents").select("doc_id", F.col("source").alias("key")), "src3"))
query("key_array_filter", "SELECT DISTINCT doc_id FROM (SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS key FROM part) WHERE key = (SELECT min(split_part(p_name, ' ', 1)) FROM part)")(
    lambda s, d: _key_array(s, d)
)
query("key_enumerate", "SELECT DISTINCT source AS key FROM documents WHERE source IS NOT NULL")(lambda s, d: keys.key_enumerate(_t(s, d, "documents").select("doc_id", F.col("source").alias("key"))))


def _key_array(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "part")
    key = parts.agg(F.min(F.split_part("p_name", F.lit(" "), F.lit(1)))).first()[0]  # the key asked for, one string
    return keys.key_filter(parts.select(F.col("p_partkey").alias("doc_id"), F.explode(F.split("p_name", " ")).alias("key")), key)


# -- points: derived from event ids by whole-number arithmetic, alike in both engines


def _points(spark: SparkSession, d: str, doc: str = "event_id") -> DataFrame:
    lat = ((F.col("event_id") * 7919) % 17001).cast("double") / 100 - 85
    lon = ((F.col("event_id") * 104729) % 36001).cast("double") / 100 - 180
    return _t(spark, d, "events").select(F.col(doc).alias("doc_id"), lat.alias("lat"), lon.alias("lon"))


_POINTS = "SELECT {doc} AS doc_id, CAST((event_id * 7919) % 17001 AS DOUBLE) / 100 - 85 AS lat, CAST((event_id * 104729) % 36001 AS DOUBLE) / 100 - 180 AS lon FROM events"
_BOX = (-20.0, 35.5, -60.0, 75.25)
_CENTRE = (41.9, 12.5, 2_500_000.0)
_POLYGON = [(-30.0, -40.0), (45.0, -55.0), (10.0, 5.0), (50.0, 60.0), (-25.0, 70.0)]
_IN_BOX = "lat BETWEEN {} AND {} AND lon BETWEEN {} AND {}".format(*_BOX)
_AWAY = f"2 * {G.EARTH_METRES} * asin(sqrt(least(1.0, pow(sin(radians(lat - {_CENTRE[0]}) / 2), 2) + cos(radians({_CENTRE[0]})) * cos(radians(lat)) * pow(sin(radians(lon - {_CENTRE[1]}) / 2), 2))))"
_IN_POLYGON = "(" + " + ".join(
    f"CAST((({yi} > lat) <> ({yj} > lat)) AND lon < {xj - xi} * (lat - {yi}) / {yj - yi} + {xi} AS INTEGER)".replace("- -", "+ ").replace("+ -", "- ")
    for (yi, xi), (yj, xj) in zip(_POLYGON, [_POLYGON[-1], *_POLYGON[:-1]], strict=True)
    if yi != yj
) + ") % 2 = 1"
for _name, _condition, _call in (
    ("geo_box", _IN_BOX, lambda p, o: geo.geo_box(p, *_BOX, outside=o)),
    ("geo_radius", f"{_AWAY} <= {_CENTRE[2]}", lambda p, o: geo.geo_radius(p, *_CENTRE, outside=o)),
    ("geo_polygon", _IN_POLYGON, lambda p, o: geo.geo_polygon(p, _POLYGON, outside=o)),
):
    _source = _POINTS.format(doc="event_id")
    query(_name, f"SELECT doc_id FROM ({_source}) WHERE {_condition}")(lambda s, d, f=_call: f(_points(s, d), False))
    query(_name.replace("geo_", "geo_outside_"), f"SELECT doc_id FROM ({_source}) WHERE NOT ({_condition})")(lambda s, d, f=_call: f(_points(s, d), True))
_CODES = f"SELECT doc_id, CAST(round(lat * {G.LAT_SCALE}) AS INTEGER) AS lat, CAST(round(lon * {G.LON_SCALE}) AS INTEGER) AS lon FROM ({_POINTS.format(doc='event_id')})"
_CODE_BOX = "lat BETWEEN {} AND {} AND lon BETWEEN {} AND {}".format(*(f"CAST(round({x}::DOUBLE * {scale}::DOUBLE) AS INTEGER)" for x, scale in zip(_BOX, (G.LAT_SCALE, G.LAT_SCALE, G.LON_SCALE, G.LON_SCALE), strict=True)))
_DECODED = f"SELECT doc_id, lat / {G.LAT_SCALE} AS lat, lon / {G.LON_SCALE} AS lon FROM ({_CODES})"
query("geo_box_quantised", f"SELECT doc_id FROM ({_CODES}) WHERE {_CODE_BOX}")(lambda s, d: geo.geo_box_quantised(_points(s, d), *_BOX))
query("geo_outside_box_quantised", f"SELECT doc_id FROM ({_CODES}) WHERE NOT ({_CODE_BOX})")(lambda s, d: geo.geo_box_quantised(_points(s, d), *_BOX, outside=True))
query("geo_radius_quantised", f"SELECT doc_id FROM ({_DECODED}) WHERE {_AWAY} <= {_CENTRE[2]}")(lambda s, d: geo.geo_radius(geo.as_stored(_points(s, d)), *_CENTRE))
query("geo_polygon_quantised", f"SELECT doc_id FROM ({_DECODED}) WHERE {_IN_POLYGON}")(lambda s, d: geo.geo_polygon(geo.as_stored(_points(s, d)), _POLYGON))
for _name, _lat, _lon, _far in (("geo_radius_pole", 84.5, 100.0, 900_000.0), ("geo_radius_date_line", -10.0, 179.0, 1_500_000.0)):
    _from = f"2 * {G.EARTH_METRES} * asin(sqrt(least(1.0, pow(sin(radians(lat - {_lat}) / 2), 2) + cos(radians({_lat})) * cos(radians(lat)) * pow(sin(radians(lon - {_lon}) / 2), 2))))"
    query(_name, f"SELECT doc_id FROM ({_POINTS.format(doc='event_id')}) WHERE {_from} <= {_far}")(lambda s, d, q=(_lat, _lon, _far): geo.geo_radius(_points(s, d), *q))
query("geo_multi_point", f"SELECT doc_id FROM ({_POINTS.format(doc='user_id')}) WHERE {_IN_BOX}")(lambda s, d: geo.geo_box(_points(s, d, "user_id"), *_BOX))


# -- full text

_TOKENS = "SELECT doc_id, t.term AS term, t.pos AS pos FROM (SELECT doc_id, unnest(list_transform(toks, lambda x, i: {'term': x, 'pos': i - 1})) AS t FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS toks FROM documents WHERE text IS NOT NULL))"
_LENGTHS = "SELECT doc_id, least(len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')), 65534) AS len FROM documents WHERE text IS NOT NULL"
_STATS = "SELECT count(*) AS n, CAST(sum(len) AS DOUBLE) / count(*) AS avgl FROM lengths"


def _scored_sql(matches: str, *, boost: str = "CASE WHEN is_exact THEN 3.0 ELSE 1.0 END", tail: str, more: str = "", tf: str = "count(*)") -> str:
    """Scores from ``matches``, one row for each place (idx, term, is_exact, doc_id, pos)."""
    return f"""WITH toks AS ({_TOKENS}), lengths AS ({_LENGTHS}), stats AS ({_STATS}), matches AS ({matches}),
  postings AS (SELECT idx, term, is_exact, doc_id, {tf} AS tf FROM matches GROUP BY ALL),
  freq AS (SELECT idx, count(*) AS df FROM postings GROUP BY idx),
  ntf AS (SELECT idx, p.doc_id, sum(tf / (0.25 + 0.75 * len / avgl) * {boost}) AS s FROM postings p JOIN lengths USING (doc_id) CROSS JOIN stats WHERE tf > 0 GROUP BY ALL),
  scores AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * s / (1.2 + s)) AS score, count(DISTINCT idx) AS hit FROM ntf JOIN freq USING (idx) CROSS JOIN stats GROUP BY doc_id){more}
{tail}"""


def _query_sql(*tokens: str, on: str = "toks.term = q.tok") -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(tokens))
    return f"SELECT idx, term, term = tok AS is_exact, doc_id, pos FROM toks JOIN (VALUES {values}) q(idx, tok) ON {on}"


_ALL = "SELECT doc_id, round(score, 6) AS score FROM scores"


def _index(spark: SparkSession, d: str, **options) -> text.TextIndex:
    return text.TextIndex.of(_t(spark, d, "documents"), **options)


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("score", 6).alias("score"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Best k with their rank; only these k rows meet in one task. Scores are rounded first: equal ones tie in both engines."""
    best = text.top_k(_rounded(found), k)
    return best.select("doc_id", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")).cast("long").alias("rank"))


@query("text_postings", f"SELECT term, doc_id, array_to_string(list_sort(list(pos)), ',') AS places FROM ({_TOKENS}) GROUP BY term, doc_id")
def text_postings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings().select("term", "doc_id", F.array_join(F.col("exact").cast("array<string>"), ",").alias("places"))


@query("text_doc_lengths", f"SELECT doc_id, CAST(len AS BIGINT) AS field_length FROM ({_LENGTHS})")
def text_doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).lengths.select("doc_id", F.col("field_length").cast("long").alias("field_length"))


@query("text_corpus_stats", f"SELECT count(*) AS n_docs, CAST(sum(len) AS BIGINT) AS n_tokens, round(CAST(sum(len) AS DOUBLE) / count(*), 6) AS avg_length FROM ({_LENGTHS})")
def text_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stats().withColumn("avg_length", F.round("avg_length", 6))


@query("text_df", f"WITH toks AS ({_TOKENS}) SELECT idx AS token_idx, count(*) AS df FROM (SELECT DISTINCT idx, term, doc_id FROM ({_query_sql('the', 'from', 'heing')})) GROUP BY idx")
def text_df(spark: SparkSession, d: str) -> DataFrame:
    return text.document_frequency(text.matched(_index(spark, d), text.Search(("the", "from", "heing"))))


@query("text_exact", _scored_sql(_query_sql("from", "heing"), tail=_ALL))
def text_exact(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(text.search(_index(spark, d), text.Search(("from", "heing"))))


@query("text_top_k", _scored_sql(_query_sql("estion", "ndst", "from"), tail="SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores ORDER BY round(score, 6) DESC, doc_id LIMIT 10"))
def text_top_k(spark: SparkSession, d: str) -> DataFrame:
    return ranked(text.search(_index(spark, d), text.Search(("estion", "ndst", "from"))), 10)


@query("text_prefix", _scored_sql(_query_sql("estio", "thti", on="starts_with(toks.term, q.tok)"), tail=_ALL))
def text_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(text.search(_index(spark, d), text.Search(("estio", "thti"), tolerance=None)))


@query("text_fuzzy", _scored_sql("SELECT * FROM (" + _query_sql("heing", "estion", on="regexp_full_match(toks.term, '[a-z]+') AND levenshtein(toks.term, q.tok) <= 1") + ")", tail=_ALL))
def text_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Terms of other letters are left out: DuckDB counts edits in bytes, Spark in code points."""
    plain = lambda t: F.filter(text.tokens(t), lambda x: x.rlike("^[a-z]+$"))
    whole, some = _index(spark, d), _index(spark, d, tokenizer=plain)
    postings = lambda condition: some.postings_where(condition).drop("field_length")  # lengths count all terms
    return _rounded(text.search(text.TextIndex(postings, whole.lengths), text.Search(("heing", "estion"), tolerance=1)))


_STEM = "regexp_replace({}, '(ing|ed|s)$', '')"
_STEMMED = f"SELECT 0 AS idx, term, true AS is_exact, doc_id, sum(CAST(ex AS INTEGER)) AS exact FROM (SELECT term, doc_id, true AS ex FROM toks WHERE term = 'an' UNION ALL SELECT {_STEM.format('term')}, doc_id, false FROM toks WHERE {_STEM.format('term')} = 'an') GROUP BY term, doc_id"


@query("text_exact_flag", _scored_sql(_STEMMED, tf="max(exact)", tail=_ALL))
def text_exact_flag(spark: SparkSession, d: str) -> DataFrame:
    """Only exact places count, while documents that hold just the stem count to df."""
    index = _index(spark, d, stemmer=lambda t: F.regexp_replace(t, "(ing|ed|s)$", ""))
    return _rounded(text.search(index, text.Search(("an",), exact_match=True)))


@query("text_boosted", _scored_sql(_query_sql("from", "heing"), boost="2.5 * CASE WHEN is_exact THEN 3.0 ELSE 1.0 END", tail=_ALL))
def text_boosted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(text.search(_index(spark, d), text.Search(("from", "heing"), boost=2.5)))


@query("text_min_match", _scored_sql(_query_sql("the", "from", "heing"), tail=_ALL + " WHERE hit >= 3"))
def text_min_match(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(text.search(_index(spark, d), text.Search(("the", "from", "heing"), min_match=3)))


_PAIRS = """, pairs AS (SELECT doc_id, count(*) AS adjacent FROM (SELECT DISTINCT a.doc_id, a.idx FROM matches a JOIN matches b ON a.doc_id = b.doc_id AND b.idx = a.idx + 1 AND b.pos = a.pos + 1) GROUP BY doc_id)"""


@query("text_phrase", _scored_sql(_query_sql("of", "the", "from"), more=_PAIRS, tail="SELECT doc_id, round(score * (1 + coalesce(adjacent, 0) * 2.0), 6) AS score FROM scores LEFT JOIN pairs USING (doc_id)"))
def text_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(text.search(_index(spark, d), text.Search(("of", "the", "from"), phrase_boost=2.0)))


@query("text_filtered", _scored_sql("SELECT * FROM (" + _query_sql("the", "heing") + ") WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", tail=_ALL))
def text_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(text.search(_index(spark, d), text.Search(("the", "heing")), _t(spark, d, "labels").where("quality = 1")))


@query("text_contributions", _scored_sql(_query_sql("from", "that"), tail="SELECT idx AS token_idx, doc_id, round(s, 6) AS ntf FROM ntf"))
def text_contributions(spark: SparkSession, d: str) -> DataFrame:
    return text.contributions(_index(spark, d), text.Search(("from", "that"))).select("token_idx", "doc_id", F.round("ntf", 6).alias("ntf"))


_FIRST = "SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents WHERE text IS NOT NULL"
_BM25F = f"""WITH head AS ({_FIRST}),
  fields AS (SELECT 0 AS f, 2.0 AS w, doc_id, text FROM head UNION ALL SELECT 1, 1.0, doc_id, text FROM documents WHERE text IS NOT NULL),
  toks AS (SELECT f, w, doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS t FROM fields),
  stats AS (SELECT f, avg(len(t)) AS avgl FROM toks GROUP BY f),
  hits AS (SELECT f, w, doc_id, idx, len(list_filter(t, lambda x: x = tok)) AS tf, len(t) AS l FROM toks CROSS JOIN (VALUES (0, 'from'), (1, 'that')) q(idx, tok) WHERE list_contains(t, tok)),
  ntf AS (SELECT idx, doc_id, sum(w * 3.0 * tf / (0.25 + 0.75 * l / avgl)) AS s FROM hits JOIN stats USING (f) GROUP BY ALL),
  freq AS (SELECT idx, count(DISTINCT doc_id) AS df FROM hits GROUP BY idx), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * s / (1.2 + s)), 6) AS score FROM ntf JOIN freq USING (idx) CROSS JOIN n GROUP BY doc_id"""


@query("text_bm25f_two_fields", _BM25F)
def text_bm25f_two_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where("text is not null")
    head = docs.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"))
    request = text.Search(("from", "that"))
    return _rounded(text.bm25f([(text.TextIndex.of(head), request, 2.0), (text.TextIndex.of(docs), request, 1.0)], docs.select("doc_id")))


@query("text_multiplied", _scored_sql(_query_sql("from"), tail="SELECT doc_id, round(score * (CASE WHEN quality = 1 THEN 1.5 WHEN quality = 0 THEN 0.5 ELSE 1.0 END), 6) AS score FROM scores LEFT JOIN labels USING (doc_id)"))
def text_multiplied(spark: SparkSession, d: str) -> DataFrame:
    factors = _t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.5).otherwise(0.5).alias("factor"))
    return _rounded(text.multiply_scores(text.search(_index(spark, d), text.Search(("from",))), factors))


# -- vectors: the vector searched for is a formula, alike in both engines

_QUERY = [((i * 37) % 64 - 32) / 100 for i in range(64)]
_V = f"[{', '.join(map(str, _QUERY))}]"
_E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_DISTANCES = {
    "l2": f"list_sum(list_transform(list_zip({_E}, {_V}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "dot": f"-list_inner_product({_E}, {_V})",
    "cosine": f"1 - list_inner_product({_E}, {_V}) / (sqrt(list_inner_product({_E}, {_E})) * sqrt(list_inner_product({_V}, {_V})))",
}


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return ingest.vector_entries(_t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), 64)


def _near(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("distance", 6).alias("distance"), F.row_number().over(Window.orderBy("distance", "doc_id")).cast("long").alias("rank"))


def _near_sql(metric: str, where: str = "true", doc: str = "vec_id") -> str:
    return f"SELECT doc_id, round(x, 6) AS distance, row_number() OVER (ORDER BY x, doc_id) AS rank FROM (SELECT {doc} AS doc_id, min({_DISTANCES[metric]}) AS x FROM embeddings WHERE {where} GROUP BY 1) ORDER BY x, doc_id LIMIT 10"


for _metric in _DISTANCES:
    query(f"vec_{_metric}", _near_sql(_metric))(lambda s, d, m=_metric: _near(vector.knn(_vectors(s, d), _QUERY, 10, m, dim=64, per_document=1)))
query("vec_filtered", _near_sql("cosine", "label = 3"))(
    lambda s, d: _near(vector.knn(_vectors(s, d), _QUERY, 10, "cosine", _t(s, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id")), 64, per_document=1))
)
query("vec_multi", _near_sql("l2", doc="vec_id // 4"))(
    lambda s, d: _near(vector.knn(_vectors(s, d).withColumns({"ord": (F.col("doc_id") % 4).cast("int"), "doc_id": F.expr("doc_id div 4")}), _QUERY, 10, "l2"))
)


@query("vec_ann")
def vec_ann(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: no SQL gives the same rows; tests measure the recall."""
    return _near(AnnIndex.build(_vectors(spark, d), work_folder(spark, "ann"), "l2").search(_QUERY, 10))


query("vec_ann_all_cells", _near_sql("cosine"))(lambda s, d: _near(AnnIndex.build(_vectors(s, d), work_folder(s, "ann"), "cosine", cells=20).search(_QUERY, 10, probes=20, rescored=100_000)))



@query("vec_calibration", "SELECT CAST(pos - 1 AS INTEGER) AS pos, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY pos")
def vec_calibration(spark: SparkSession, d: str) -> DataFrame:
    return vector.calibration(_vectors(spark, d)).select("pos", F.round(F.col("low").cast("double"), 6).alias("low"), F.round(F.col("high").cast("double"), 6).alias("high"))


# -- the operation log: events are operations on users; every seventh deletes

_NUM = FieldSpec("value", "number")
_OPS = "SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'insert' END AS op, user_id AS doc_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"
_LIVE = "SELECT DISTINCT o.doc_id, o.value FROM ({ops}) o LEFT JOIN (SELECT doc_id, max(seq) AS gone FROM ({ops}) WHERE op = 'delete' GROUP BY doc_id) g USING (doc_id) WHERE o.op = 'insert' AND (gone IS NULL OR o.seq > gone)".format(ops=_OPS)


def _ops(spark: SparkSession, d: str) -> DataFrame:
    gone = F.col("event_id") % 7 == 0
    return _t(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(gone, "delete").otherwise("insert").alias("op"), F.col("user_id").alias("doc_id"), F.when(~gone, F.col("value")).alias("value"))


query("oplog_live_view", _LIVE)(lambda s, d: live_view(_ops(s, d), _NUM).select("doc_id", "value"))


@query("oplog_delete_reinsert", f"SELECT doc_id, count(*) AS n, max(value) AS highest FROM ({_LIVE}) WHERE doc_id IN (SELECT doc_id FROM ({_OPS}) WHERE op = 'delete') GROUP BY doc_id")
def oplog_delete_reinsert(spark: SparkSession, d: str) -> DataFrame:
    ops = _ops(spark, d)
    again = ids.only(live_view(ops, _NUM), ops.where("op = 'delete'").select("doc_id").distinct())
    return again.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("value").alias("highest"))


@query("oplog_compact_invariance", _LIVE)
def oplog_compact_invariance(spark: SparkSession, d: str) -> DataFrame:
    """The first half folded into a segment, the second half still in the log: the same rows as the whole log folded."""
    ops = _ops(spark, d)
    half = ops.agg((F.max("seq") / 2).cast("long")).first()[0]  # one number
    segment, recent = live_view(ops.where(F.col("seq") <= half), _NUM), ops.where(F.col("seq") > half)
    return visible(segment, hidden(recent, _NUM)).unionByName(live_view(recent, _NUM)).select("doc_id", "value").distinct()


@query("oplog_last_insert", f"SELECT doc_id, arg_max(value, seq) AS value FROM ({_OPS}) WHERE op = 'insert' GROUP BY doc_id")
def oplog_last_insert(spark: SparkSession, d: str) -> DataFrame:
    """Of a replacing field the last insert counts, here without the deletes."""
    spec = FieldSpec("value", "text")
    ops = _ops(spark, d).where("op = 'insert'").select("seq", "op", "doc_id", F.col("value").cast("string").alias("term"), *[F.lit(None).alias(c) for c in ("exact", "stemmed", "field_length")])
    return live_view(ops, spec).select("doc_id", F.col("term").cast("double").alias("value"))


# -- inspection


@query("info_bool", f"SELECT count(*) FILTER (value) AS true_count, count(*) FILTER (NOT value) AS false_count FROM ({_FINISHED})")
def info_bool(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, d).agg(F.count_if("value").alias("true_count"), F.count_if(~F.col("value")).alias("false_count"))


@query("info_number", f"SELECT count(*) AS entries, count(DISTINCT value) AS unique_values, min(value) AS lowest, max(value) AS highest FROM ({_SIZES})")
def info_number(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).agg(F.count("*").alias("entries"), F.count_distinct("value").alias("unique_values"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("info_string", f"SELECT count(DISTINCT term) AS unique_terms, count(DISTINCT (term, doc_id)) AS postings FROM ({_TOKENS})")
def info_string(spark: SparkSession, d: str) -> DataFrame:
    """Distinct terms from counts of their documents: one exchange of combined rows, no distinct expansion."""
    words = _t(spark, d, "documents").where("text is not null").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_terms"), F.sum("n").alias("postings"))


@query("info_key", "SELECT count(DISTINCT source) AS unique_keys, count(DISTINCT (source, doc_id)) AS postings FROM documents")
def info_key(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "documents").where("source is not null").select("source", "doc_id").distinct()
    return pairs.groupBy("source").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_keys"), F.sum("n").alias("postings"))


# -- sets of ids

_LONG, _GOOD = "SELECT doc_id FROM documents WHERE n_chars >= 2000", "SELECT doc_id FROM labels WHERE quality = 1"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _t(spark, d, "documents").where("n_chars >= 2000").select("doc_id"), _t(spark, d, "labels").where("quality = 1").select("doc_id")


query("ids_union", f"{_LONG} UNION {_GOOD}")(lambda s, d: ids.ids_union(*_two(s, d)))
query("ids_union_desc", f"SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM ({_LONG} UNION {_GOOD})")(lambda s, d: with_rank(ids.ordered(ids.ids_union(*_two(s, d)), True), F.col("doc_id").desc()))
query("ids_except_desc", f"SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM ({_LONG} EXCEPT {_GOOD})")(lambda s, d: with_rank(ids.ordered(ids.ids_except(*_two(s, d)), True), F.col("doc_id").desc()))
query("ids_except", f"{_LONG} EXCEPT {_GOOD}")(lambda s, d: ids.ids_except(*_two(s, d)))
query("ids_intersect", f"{_LONG} INTERSECT {_GOOD}")(lambda s, d: ids.ids_intersect(*_two(s, d)))


# -- JSON values: strict types, made alike in both engines from event ids


def _json(spark: SparkSession, d: str, *cases: str) -> DataFrame:
    """(doc_id, json): the case that event_id modulo their number names; each is SQL that both engines read alike."""
    return _t(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.expr(_cases(cases)).alias("json"))


def _cases(cases: tuple[str, ...]) -> str:
    return "CASE event_id % {} {} END".format(len(cases), " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)))


_EVENT = "CAST(event_id AS STRING)"
query("json_bool", "SELECT event_id AS doc_id, event_id % 6 = 0 AS value FROM events WHERE event_id % 6 IN (0, 1)")(
    lambda s, d: ingest.bool_entries(_json(s, d, "'true'", "'false'", "'\"true\"'", "'1'", "'null'", "'[true]'"))
)
query("json_bool_array", "SELECT event_id AS doc_id, true AS value FROM events WHERE event_id % 4 IN (0, 1) UNION ALL SELECT event_id, false FROM events WHERE event_id % 4 = 0")(
    lambda s, d: ingest.bool_entries(_json(s, d, "'[true, false, true]'", "'[true, 1, \"false\", null]'", "'[]'", "'true'"), is_array=True)
)
query("json_double", "SELECT event_id AS doc_id, CASE event_id % 5 WHEN 0 THEN event_id / 4 ELSE CAST(event_id AS DOUBLE) END AS value FROM events WHERE event_id % 5 IN (0, 1)")(
    lambda s, d: ingest.number_entries(_json(s, d, "CAST(CAST(event_id / 4 AS DECIMAL(20, 2)) AS STRING)", _EVENT, f"concat('\"', {_EVENT}, '\"')", "'true'", "'{{}}'"))
)
query("json_number_array", "SELECT event_id AS doc_id, event_id AS value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, event_id + 1 FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 7 FROM events WHERE event_id % 3 = 1")(
    lambda s, d: ingest.number_entries(_json(s, d, f"concat('[', {_EVENT}, ', ', CAST(event_id + 1 AS STRING), ']')", "'[7, \"8\", 9.5, null]'", "'9'"), number="long", is_array=True)
)
query("json_key", "SELECT event_id AS doc_id, CASE event_id % 5 WHEN 0 THEN event_type ELSE '' END AS key FROM events WHERE event_id % 5 IN (0, 1)")(
    lambda s, d: ingest.key_entries(_json(s, d, "concat('\"', event_type, '\"')", "'\"\"'", "'1'", "'null'", "'[\"a\"]'"))
)
query("json_key_accepted", "SELECT event_id AS doc_id, unnest(CASE event_id % 2 WHEN 0 THEN ['longer'] ELSE ['abcd', 'efgh'] END) AS key FROM events")(
    lambda s, d: ingest.key_entries(_json(s, d, "'[\"longer\", \"a\", 5, \"longer\"]'", "'[\"abcd\", \"\", \"efgh\"]'"), is_array=True, accepts=lambda key: F.char_length(key) >= 4)
)
query("json_text", "SELECT event_id AS doc_id, CASE event_id % 4 WHEN 0 THEN 'One ' || event_type ELSE 'two three' END AS text FROM events WHERE event_id % 4 IN (0, 1)")(
    lambda s, d: ingest.text_values(_json(s, d, "concat('[\"One\", \"', event_type, '\"]')", "'[\"two three\"]'", "'[\"two\", 3]'", "'\"two\"'"), is_array=True)
)
query("json_geo", "SELECT event_id AS doc_id, CAST(event_id % 90 AS DOUBLE) AS lat, -12.5 AS lon FROM events WHERE event_id % 5 = 0")(
    lambda s, d: ingest.geo_entries(_json(s, d, "concat('{\"lat\": ', CAST(event_id % 90 AS STRING), ', \"lon\": -12.5}')", "'{\"lat\": \"1\", \"lon\": 2}'", "'{\"lat\": 91, \"lon\": 2}'", "'{\"lat\": 1}'", "'[1, 2]'"))
)
query("json_geo_array", "SELECT event_id AS doc_id, 1.0 AS lat, unnest([2.0, 4.0]) AS lon FROM events WHERE event_id % 2 = 0")(
    lambda s, d: ingest.geo_entries(_json(s, d, "'[{\"lat\": 1, \"lon\": 2}, {\"lat\": 1, \"lon\": 200}, {\"lat\": 1.0, \"lon\": 4}]'", "'{\"lat\": 1, \"lon\": 2}'"), is_array=True)
)


# -- stored fields: rows are inserted, a third deleted, folded into a version, half of those inserted again and left in the log


def _stored(spark: SparkSession, spec: FieldSpec, entries: DataFrame, changed: DataFrame | None = None) -> FieldIndex:
    """``changed`` are the entries that come back; by default the same ones."""
    index = FieldIndex(spark, work_folder(spark, spec.name), spec)
    index.insert(entries)
    index.delete(index.ops().where("doc_id % 3 = 0").select("doc_id").distinct())  # the log has the ids; the entries would be made anew
    index.compact(1)
    index.insert((entries if changed is None else changed).where("doc_id % 6 = 0"))
    return index


_SEEN = "(doc_id % 3 <> 0 OR doc_id % 6 = 0)"
_INDEXES: dict[str, Callable[[SparkSession, str], FieldIndex]] = {
    "bool": lambda s, d: _stored(s, FieldSpec("bool", "bool"), _finished(s, d)),
    "number": lambda s, d: _stored(s, FieldSpec("number", "number", number="long"), _sizes(s, d)),
    "key": lambda s, d: _stored(s, FieldSpec("key", "key"), _t(s, d, "documents").where("source is not null").select("doc_id", F.col("source").alias("key"))),
    "text": lambda s, d: _stored(s, FieldSpec("text", "text"), ingest.text_entries(_t(s, d, "documents"), text.tokens), ingest.text_entries(_t(s, d, "documents").where("doc_id % 6 = 0"), text.tokens)),
    "geo": lambda s, d: _stored(s, FieldSpec("geo", "geo"), _points(s, d)),
    "vector": lambda s, d: _stored(s, FieldSpec("vector", "vector", dim=64, metric="l2"), _vectors(s, d)),
}


def _folded(index: FieldIndex) -> FieldIndex:
    index.compact(2)
    return index


query("index_bool", f"SELECT DISTINCT doc_id FROM ({_FINISHED}) WHERE value AND {_SEEN}")(lambda s, d: boolean.bool_filter(_INDEXES["bool"](s, d).entries(), True))
query("index_number", f"SELECT DISTINCT doc_id, value FROM ({_SIZES}) WHERE value BETWEEN 10 AND 20 AND {_SEEN}")(lambda s, d: number.number_filter(_INDEXES["number"](s, d).entries(), "between", 10, 20))
query("index_number_folded", f"SELECT *, row_number() OVER (ORDER BY value, doc_id) AS rank FROM ({_SIZES}) WHERE {_SEEN}")(
    lambda s, d: with_rank(number.number_sort(_folded(_INDEXES["number"](s, d)).entries()), "value", "doc_id")
)
query("index_key", f"SELECT DISTINCT doc_id FROM documents WHERE source = 'src3' AND {_SEEN}")(lambda s, d: keys.key_filter(_INDEXES["key"](s, d).entries(), "src3"))
query("index_key_enumerate", f"SELECT DISTINCT source AS key FROM documents WHERE source IS NOT NULL AND {_SEEN}")(lambda s, d: keys.key_enumerate(_folded(_INDEXES["key"](s, d)).entries()))
query("index_geo", f"SELECT doc_id FROM ({_POINTS.format(doc='event_id')}) WHERE {_AWAY} <= {_CENTRE[2]} AND {_SEEN}")(lambda s, d: geo.geo_radius(_INDEXES["geo"](s, d).entries(), *_CENTRE))
query("index_geo_folded", f"SELECT doc_id FROM ({_POINTS.format(doc='event_id')}) WHERE NOT ({_IN_POLYGON}) AND {_SEEN}")(lambda s, d: geo.geo_polygon(_folded(_INDEXES["geo"](s, d)).entries(), _POLYGON, outside=True))
query("index_vector", _near_sql("l2", "(vec_id % 3 <> 0 OR vec_id % 6 = 0)"))(lambda s, d: _near(vector.knn(_INDEXES["vector"](s, d).entries(), _QUERY, 10, "l2", dim=64)))
query("index_vector_folded", _near_sql("cosine", "(vec_id % 3 <> 0 OR vec_id % 6 = 0)"))(lambda s, d: _near(vector.knn(_folded(_INDEXES["vector"](s, d)).entries(), _QUERY, 10, "cosine")))


def _seen(sql: str) -> str:
    """A query over documents, asked of those that are visible."""
    return sql.replace("FROM documents WHERE text IS NOT NULL", f"FROM documents WHERE text IS NOT NULL AND {_SEEN}")


query("index_text", _seen(SQL["text_exact"]))(lambda s, d: _rounded(text.search(_INDEXES["text"](s, d).text_index(), text.Search(("from", "heing")))))
query("index_text_folded", _seen(SQL["text_phrase"]))(lambda s, d: _rounded(text.search(_folded(_INDEXES["text"](s, d)).text_index(), text.Search(("of", "the", "from"), phrase_boost=2.0))))
query("index_text_prefix", _seen(SQL["text_prefix"]))(lambda s, d: _rounded(text.search(_folded(_INDEXES["text"](s, d)).text_index(), text.Search(("estio", "thti"), tolerance=None))))
query("index_text_stats", _seen(SQL["text_corpus_stats"]))(lambda s, d: _folded(_INDEXES["text"](s, d)).text_index().stats().withColumn("avg_length", F.round("avg_length", 6)))

# Before the second version: one segment of the rows that were not deleted, nothing carried along, the rest in the log.
_COUNTS = "SELECT count(*) AS entries, count(DISTINCT doc_id) AS documents{more}, count(*) FILTER (doc_id % 6 = 0) AS pending_inserts, 0::BIGINT AS pending_deletes, 1 AS version, 1 AS segments, 0 AS deleted, '{kind}' AS kind FROM ({rows}) WHERE {seen}"
for _kind, _rows, _more in (
    ("bool", _FINISHED, ", count(*) FILTER (value) AS true_count, count(*) FILTER (NOT value) AS false_count"),
    ("number", _SIZES, ""),
    ("key", "SELECT doc_id, source AS key FROM documents WHERE source IS NOT NULL", ", count(DISTINCT key) AS unique_keys"),
    ("geo", _POINTS.format(doc="event_id"), ""),
    ("vector", "SELECT vec_id AS doc_id FROM embeddings", ", 64 AS dim, 'l2' AS metric"),
):
    query(f"index_info_{_kind}", _COUNTS.format(more=_more, kind=_kind, rows=_rows, seen=_SEEN))(lambda s, d, k=_kind: _INDEXES[k](s, d).info().drop("bytes"))
query(
    "index_info_text",
    f"WITH toks AS (SELECT * FROM ({_TOKENS}) WHERE {_SEEN}), lengths AS (SELECT * FROM ({_LENGTHS}) WHERE {_SEEN}), p AS (SELECT DISTINCT term, doc_id FROM toks) "
    "SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM lengths WHERE len = 0) AS entries, (SELECT count(*) FROM lengths) AS documents, (SELECT count(DISTINCT term) FROM p) AS unique_terms, "
    "count(*) AS n_docs, CAST(sum(len) AS BIGINT) AS n_tokens, round(CAST(sum(len) AS DOUBLE) / count(*), 6) AS avg_length, "
    "0::BIGINT AS pending_inserts, 0::BIGINT AS pending_deletes, 2 AS version, 1 AS segments, 0 AS deleted, 'text' AS kind FROM lengths",
)(lambda s, d: _folded(_INDEXES["text"](s, d)).info().drop("bytes").withColumn("avg_length", F.round("avg_length", 6)))
query("index_check", f"SELECT unnest(['bool', 'number', 'key', 'text', 'geo', 'vector']) AS kind, c.* FROM (SELECT unnest(['current', 'manifest', 'files', 'schema', 'rows', 'order', 'tombstones']) AS \"check\", 'ok' AS status) c")(
    lambda s, d: _checks(s, d)
)


def _checks(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, make in _INDEXES.items():
        rows = make(spark, d).integrity_check().select(F.lit(kind).alias("kind"), "check", "status")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("index_versions", "SELECT * FROM (VALUES ('first', 1, 1, false), ('carried', 2, 2, true), ('applied', 3, 1, false), ('cleaned', 3, 1, false), ('opened again', 3, 1, false)) t(step, version, segments, tombstones)")
def index_versions(spark: SparkSession, d: str) -> DataFrame:
    """What each compaction leaves: a few deletes are carried along, many are applied, a cleanup changes nothing."""
    root, spec, steps = work_folder(spark, "versions"), FieldSpec("n", "number", number="long"), []
    index = FieldIndex(spark, root, spec)

    def step(name: str, i: FieldIndex) -> None:
        m = i.store.manifest()
        steps.append((name, i.store.current(), len(m["segments"]), m["tombstones"] is not None))

    index.insert(_sizes(spark, d))
    index.compact(1)
    step("first", index)
    index.delete(_sizes(spark, d).where("doc_id % 20 = 0").select("doc_id"))
    index.compact(2)
    step("carried", index)
    index.delete(_sizes(spark, d).where("doc_id % 3 = 0").select("doc_id"))
    index.compact(3)
    step("applied", index)
    index.cleanup()
    step("cleaned", index)
    step("opened again", FieldIndex(spark, root, spec))
    return spark.createDataFrame(steps, "step string, version int, segments int, tombstones boolean")
