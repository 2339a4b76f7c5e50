"""The pipeline's stages against the operators they use, and the registered queries."""

import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sieveline.llm import neardup, quality
from sieveline.llm.queries import ORACLE_SQL, QUERIES

from .test_text import brute_components


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "personal data", "packing"]


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{data}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        folder = f"{tmp_path_factory.mktemp('stages')}/{k}"
        stage(spark, docs, data).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def test_stages(spark, data, stages):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good, single, clean, packed = stages
    assert good.columns == single.columns == clean.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    accepted = {r["doc_id"] for r in quality.score(docs, model).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted
    kept = {r["doc_id"] for r in neardup.near_duplicates(good, 80).where("kept").collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(kept)
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (single, clean))
    assert set(before) == set(after)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for k, r in after.items():
        assert not email.search(r["text"] or "") and r["n_chars"] == len(r["text"] or "")
        if not re.search("[0-9@]", before[k]["text"] or ""):
            assert r["text"] == before[k]["text"]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_run_equals_the_stages(spark, data, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    same = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert same(corpus_pipeline.run(spark, data)) == same(stages[-1])


def test_stages_on_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_stages_on_odd_rows(spark, data, odd, tmp_path):
    """Null ids and texts, repeated rows and clashing columns through all stages, each written and read again."""
    docs, had = odd, odd.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert sorted({str(r["doc_id"]) for r in after.collect()}) == sorted({str(r["doc_id"]) for r in docs.collect()})
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
        else:
            assert after.columns == odd.columns and after.count() <= had
            had = after.count()
        docs = after


def test_near_duplicate_stage_links_from_080(spark, data, stages):
    good, single, *_ = stages
    groups = brute_components([(r["doc_id"], r["text"]) for r in good.collect()], percent=80)
    assert {r["doc_id"] for r in single.collect()} == {k for k, (_, component) in groups.items() if k == component}
    pairs = []  # of similarity 0.80 to 0.85
    for k in range(150):
        words = [f"w{k}x{i}" for i in range(104 + k)]
        end = round(0.9 * (100 + k)) + 4
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:end] + [f"v{k}x{i}" for i in range(len(words) - end)]))]
    expected = {k for k, (_, component) in brute_components(pairs, percent=80).items() if k == component}
    assert len(expected) < 160 and len({c for _, c in brute_components(pairs).values()}) == 300
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, data).collect()} == expected


def test_signatures_reach_080():
    size = neardup.size_for(80)
    assert neardup.size_for(84) == size and neardup.size_for(90) == neardup.SIZES[85] and size.near < 2 * size.chunks
    with pytest.raises(ValueError):
        neardup.size_for(79)
    rng = np.random.default_rng(1)
    one = rng.integers(0, 256, size.places, dtype=np.uint8)
    keys = set(neardup.bucket_keys(one[None], size.chunks)[0].tolist())
    for _ in range(200):
        other = one.copy()
        places = rng.choice(size.places, size.near, replace=False)
        other[places] ^= rng.integers(1, 256, size.near, dtype=np.uint8)
        assert keys & set(neardup.bucket_keys(other[None], size.chunks)[0].tolist())
