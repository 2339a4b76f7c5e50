"""Every field query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sieveline.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = tables.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def test_queries_without_sql(spark):
    assert set(QUERIES) - set(SQL) == {"vec_ann"}
    assert QUERIES["vec_ann"](spark, DATA).count() == 10


@pytest.mark.parametrize("name,scans", [("text_exact", 2), ("text_phrase", 2), ("text_prefix", 2), ("text_bm25f_two_fields", 5)])
def test_a_search_reads_a_field_once_for_matches_and_once_for_statistics(spark, name, scans):
    df = QUERIES[name](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == scans and "Reused" in plan


def test_ranks_tell_the_order(spark, tables):
    up, down = (entry.queries()[n](spark, DATA).collect() for n in ("num_sort_asc", "num_sort_desc"))
    place = {(r["doc_id"], r["value"]): r["rank"] for r in up}
    assert sorted(place.values()) == list(range(1, len(up) + 1)) and len(up) == len(down)
    assert all(r["rank"] == len(up) + 1 - place[r["doc_id"], r["value"]] for r in down)


def test_library_does_not_need_the_corpus_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{top}/sieveline/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "llm" not in f.read(), path
