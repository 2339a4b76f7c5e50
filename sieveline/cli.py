"""Inspect stored fields: ``python -m sieveline.cli KIND COMMAND ROOT [options]``.

Commands are check and info for every kind, filter for bool, number, key and geo, show for bool, search for text and vector.
Query tokens are split on white space and not lower-cased; ``--prefix`` goes before ``--tolerance``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from sieveline.operators import boolean, geo, keys, number, text, vector
from sieveline.plans.index import FieldIndex
from sieveline.schema import FieldSpec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveline", description=__doc__.splitlines()[0])
    p.add_argument("kind", choices=("bool", "number", "key", "text", "geo", "vector"))
    p.add_argument("command", choices=("check", "info", "filter", "show", "search"))
    p.add_argument("root")
    p.add_argument("--json", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--value", help="bool: true or false; key: the key")
    p.add_argument("--type", choices=("long", "double"), default="double")
    for op in number.OPERATORS[:-1]:
        p.add_argument(f"--{op}")
    p.add_argument("--between", nargs=2, metavar=("MIN", "MAX"))
    p.add_argument("--box", help="MIN_LAT,MAX_LAT,MIN_LON,MAX_LON")
    p.add_argument("--radius", help="LAT,LON,METRES")
    p.add_argument("--polygon", help="LAT,LON;LAT,LON;...")
    p.add_argument("--outside", action="store_true", help="what lies outside the box, radius or polygon")
    p.add_argument("--query", help="text: words; vector: numbers with commas")
    p.add_argument("--tolerance", type=int, default=0)
    p.add_argument("--prefix", action="store_true")
    p.add_argument("--exact", action="store_true")
    p.add_argument("--phrase-boost", type=float, default=0.0)
    p.add_argument("--dim", type=int, default=1)
    p.add_argument("--metric", choices=("l2", "dot", "cosine"), default="l2")
    return p


def _number(a: argparse.Namespace, text_: str) -> int | float:
    return int(text_) if a.type == "long" else float(text_)


def answer(index: FieldIndex, a: argparse.Namespace) -> DataFrame:
    entries = index.entries()
    if a.kind == "bool" and a.command == "show":
        return boolean.bool_sort(entries)
    if a.kind == "bool":
        return boolean.bool_filter(entries, a.value == "true", "asc")
    if a.kind == "number":
        if a.between:
            return number.number_filter(entries, "between", *(_number(a, x) for x in a.between)).orderBy("value", "doc_id")
        op = next((op for op in number.OPERATORS[:-1] if getattr(a, op) is not None), None)
        if op is None:
            raise SystemExit("number filter needs one of --eq --gt --gte --lt --lte --between")
        return number.number_filter(entries, op, _number(a, getattr(a, op))).orderBy("value", "doc_id")
    if a.kind == "key":
        return keys.key_enumerate(entries) if a.value is None else keys.key_filter(entries, a.value).orderBy("doc_id")
    if a.kind == "geo":
        if a.box:
            return geo.geo_box(entries, *map(float, a.box.split(",")), outside=a.outside)
        if a.radius:
            return geo.geo_radius(entries, *map(float, a.radius.split(",")), outside=a.outside)
        if a.polygon:
            return geo.geo_polygon(entries, [tuple(map(float, v.split(","))) for v in a.polygon.split(";")], outside=a.outside)
        raise SystemExit("geo filter needs --box, --radius or --polygon")
    if a.query is None:
        raise SystemExit("search needs --query")
    if a.kind == "text":
        request = text.Search(tuple(a.query.split()), tolerance=None if a.prefix else a.tolerance, exact_match=a.exact, phrase_boost=a.phrase_boost)
        return text.top_k(text.search(index.text_index(), request), a.limit)
    return vector.knn(entries, [float(x) for x in a.query.split(",")], a.limit, a.metric, dim=a.dim)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sieveline").getOrCreate()
    index = FieldIndex(spark, a.root, FieldSpec("field", a.kind, number=a.type, dim=a.dim, metric=a.metric))
    if a.command == "check":
        rows = [r.asDict() for r in index.integrity_check().collect()]
        print(json.dumps(rows) if a.json else "\n".join(f"{r['status']:8} {r['check']:10} {r['details']}" for r in rows))
        return int(any(r["status"] == "failed" for r in rows))
    if a.command == "info":
        row = index.info().first().asDict()
        print(json.dumps(row) if a.json else "\n".join(f"{k}: {v}" for k, v in row.items()))
        return 0
    found = answer(index, a)
    rows, count = [r.asDict() for r in found.limit(a.limit).collect()], found.count()
    print(json.dumps({"count": count, "rows": rows}) if a.json else "\n".join([f"count: {count}", *(" ".join(map(str, r.values())) for r in rows)]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
