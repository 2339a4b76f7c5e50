"""Kinds of field and the long-format tables that hold them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

KINDS = ("bool", "number", "key", "text", "geo", "vector")
#: Kinds whose later insert of a document replaces the earlier one; the others gather entries.
REPLACING = frozenset({"text", "vector"})
MAX_FIELD_LENGTH = 65_534


@dataclass(frozen=True)
class FieldSpec:
    """A named field. ``number`` and ``ids`` are ``long`` or ``decimal`` (unsigned values above 2^63 - 1), ``number`` also
    ``double``."""

    name: str
    kind: str
    is_array: bool = False
    number: str = "double"
    dim: int = 0
    metric: str = "l2"
    ids: str = "long"
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")
        if self.kind == "vector" and not 1 <= self.dim <= 4096:
            raise ValueError("dim lies between 1 and 4096")
        if self.ids not in ("long", "decimal"):
            raise ValueError("ids are long or decimal")
        if self.metric not in ("l2", "dot", "cosine"):
            raise ValueError("metric is l2, dot or cosine")

    @property
    def id_type(self) -> T.DataType:
        return T.DecimalType(20, 0) if self.ids == "decimal" else T.LongType()

    @property
    def value_type(self) -> T.DataType:
        return {"long": T.LongType(), "double": T.DoubleType(), "decimal": T.DecimalType(20, 0)}[self.number]

    @property
    def entries(self) -> T.StructType:
        """Columns of an entry besides doc_id."""
        if self.kind == "bool":
            return T.StructType().add("value", T.BooleanType())
        if self.kind == "number":
            return T.StructType().add("value", self.value_type)
        if self.kind == "key":
            return T.StructType().add("key", T.StringType())
        if self.kind == "geo":
            return T.StructType().add("lat", T.DoubleType()).add("lon", T.DoubleType())
        if self.kind == "vector":
            return T.StructType().add("ord", T.IntegerType()).add("vec", T.ArrayType(T.FloatType()))
        places = T.ArrayType(T.IntegerType())
        return T.StructType().add("term", T.StringType()).add("exact", places).add("stemmed", places).add("field_length", T.IntegerType())
