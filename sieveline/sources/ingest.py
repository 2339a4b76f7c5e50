"""JSON values and vectors to entries, by strict types: a value of another JSON type is not indexed, never coerced.

Scalars are read with a typed schema, which does not coerce. In arrays a typed schema would void the whole array for one
odd element, so that elements are read as VARIANT and sorted by their own type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.geo import in_range
from sieveline.functions.vectors import usable
from sieveline.schema import FieldSpec


def _elements(json: Column) -> Column:
    """Elements of a JSON array as VARIANT; null for what is no array."""
    value = F.try_parse_json(json)
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _scalar(json: Column, kinds: tuple[str, ...], to: str) -> Column:
    value = F.try_parse_json(json)
    kind = F.regexp_extract(_kind(value), r"^[A-Z]+", 0)
    return F.when(kind.isin(*kinds), F.try_variant_get(value, "$", to))


def bool_entries(rows: DataFrame, json: str = "json", is_array: bool = False) -> DataFrame:
    """(doc_id, value). Elements that are no booleans are skipped; nothing left, nothing indexed."""
    if not is_array:
        return rows.select("doc_id", _scalar(F.col(json), ("BOOLEAN",), "boolean").alias("value")).where("value is not null")
    kept = F.transform(F.filter(_elements(F.col(json)), lambda v: _kind(v) == "BOOLEAN"), lambda v: F.variant_get(v, "$", "boolean"))
    return rows.select("doc_id", F.explode(F.array_distinct(kept)).alias("value"))


def _number(v: Column, number: str) -> Column:
    kind = F.regexp_extract(_kind(v), r"^[A-Z]+", 0)
    if number == "double":
        return F.when(kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(v, "$", "double"))
    if number == "long":
        return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    whole = F.when((kind == "BIGINT") | _kind(v).rlike(r"^DECIMAL\((19|20),0\)$"), F.try_variant_get(v, "$", "decimal(20,0)"))
    return F.when((whole >= 0) & (whole <= F.lit("18446744073709551615").cast("decimal(20,0)")), whole)


def number_entries(rows: DataFrame, json: str = "json", number: str = "double", is_array: bool = False) -> DataFrame:
    """(doc_id, value). 1.0 is no integer; -0.0 keeps its sign; elements of other types are skipped."""
    if not is_array:
        # VARIANT loses the sign of a zero; the typed reader keeps it and does not coerce strings.
        if number == "double":
            wrapped = F.concat(F.lit('{"v":'), F.col(json), F.lit("}"))
            value = F.from_json(wrapped, "v double").getField("v")
            return rows.select("doc_id", F.when(_number(F.try_parse_json(F.col(json)), "double").isNotNull(), value).alias("value")).where("value is not null and not isnan(value)")
        return rows.select("doc_id", _number(F.try_parse_json(F.col(json)), number).alias("value")).where("value is not null")
    kept = F.filter(F.transform(_elements(F.col(json)), lambda v: _number(v, number)), lambda x: x.isNotNull())
    if number == "double":
        kept = F.coalesce(F.filter(F.from_json(F.col(json), "array<double>"), lambda x: x.isNotNull() & ~F.isnan(x)), kept)
    return rows.select("doc_id", F.explode(kept).alias("value"))


def key_entries(rows: DataFrame, json: str = "json", is_array: bool = False, accepts: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, key) of strings that ``accepts`` lets through; the empty string is a key."""
    ok = accepts or (lambda key: F.lit(True))
    if not is_array:
        found = rows.select("doc_id", _scalar(F.col(json), ("STRING",), "string").alias("key")).where("key is not null")
        return found.where(ok(F.col("key")))
    kept = F.transform(F.filter(_elements(F.col(json)), lambda v: _kind(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))
    return rows.select("doc_id", F.explode(F.filter(kept, ok)).alias("key")).distinct()


def text_values(rows: DataFrame, json: str = "json", is_array: bool = False) -> DataFrame:
    """(doc_id, text). An array with an element that is no string is not indexed; its strings make one stream of tokens."""
    if not is_array:
        return rows.select("doc_id", _scalar(F.col(json), ("STRING",), "string").alias("text")).where("text is not null")
    parts = _elements(F.col(json))
    whole = F.when(F.forall(parts, lambda v: _kind(v) == "STRING"), F.array_join(F.transform(parts, lambda v: F.variant_get(v, "$", "string")), " "))
    return rows.select("doc_id", whole.alias("text")).where("text is not null")


def text_entries(rows: DataFrame, tokenizer: Callable[[Column], Column], stemmer: Callable[[Column], Column] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, term, exact, stemmed, field_length): postings with the document's length beside them."""
    from sieveline.operators.text import TextIndex

    index = TextIndex.of(rows, text=text, tokenizer=tokenizer, stemmer=stemmer)
    return index.whole(True).select("doc_id", "term", "exact", "stemmed", "field_length")


def geo_entries(rows: DataFrame, json: str = "json", is_array: bool = False) -> DataFrame:
    """(doc_id, lat, lon) of objects with both numbers in range."""
    number = lambda v, path: F.when(F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^[A-Z]+", 0).isin("BIGINT", "DOUBLE", "DECIMAL"), F.try_variant_get(v, path, "double"))
    point = lambda v: F.struct(number(v, "$.lat").alias("lat"), number(v, "$.lon").alias("lon"))
    value = F.try_parse_json(F.col(json))
    points = F.transform(_elements(F.col(json)), point) if is_array else F.array(point(value))
    found = rows.select("doc_id", F.explode(points).alias("p")).select("doc_id", "p.lat", "p.lon")
    return found.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & in_range(F.col("lat"), F.col("lon")))


def vector_entries(rows: DataFrame, dim: int, column: str = "embedding", is_array: bool = False) -> DataFrame:
    """(doc_id, ord, vec). One vector of a wrong length, or not finite, rejects the whole value."""
    vec = F.col(column).cast("array<array<float>>" if is_array else "array<float>")
    many = vec if is_array else F.array(vec)
    good = F.when(F.col(column).isNotNull() & F.forall(many, lambda v: usable(v, dim)), many)
    return rows.select("doc_id", F.posexplode(good).alias("ord", "vec"))


def json_entries(rows: DataFrame, spec: FieldSpec, json: str = "json") -> DataFrame:
    """Entries of any kind but text and vector, by the field's specification."""
    if spec.kind == "bool":
        return bool_entries(rows, json, spec.is_array)
    if spec.kind == "number":
        return number_entries(rows, json, spec.number, spec.is_array)
    if spec.kind == "key":
        return key_entries(rows, json, spec.is_array)
    if spec.kind == "geo":
        return geo_entries(rows, json, spec.is_array)
    raise ValueError(f"{spec.kind} fields are not read from one JSON value; see text_values and vector_entries")
