"""Life of a stored field: log, compaction, inspection, command line, streaming."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline import cli
from sieveline.functions import postings
from sieveline.functions.order import runs
from sieveline.functions.vectors import I8_METRICS, quantise, quantised
from sieveline.operators import boolean, text, vector
from sieveline.operators.ann import AnnIndex
from sieveline.plans import index as plan
from sieveline.plans.index import FieldIndex
from sieveline.schema import FieldSpec
from sieveline.sources import ingest
from sieveline.sources.ingest import text_entries
from sieveline.sources.oplog import live_view
from sieveline.streaming.ingest import append_batch, stream_into


def numbers(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, value double")


def all_of(index):
    return sorted(tuple(r) for r in index.entries().collect())


def test_life_of_a_number_field(spark, tmp_path):
    index = FieldIndex(spark, f"file://{tmp_path}/n", FieldSpec("n", "number"))
    assert all_of(index) == [] and index.compact(1) is False
    index.insert(numbers(spark, [(i, float(i)) for i in range(20)]))
    index.delete([3, 999])
    index.insert(numbers(spark, [(3, 30.0)]))
    expected = sorted([(i, float(i)) for i in range(20) if i != 3] + [(3, 30.0)])
    assert all_of(index) == expected
    assert index.compact(1) and all_of(index) == expected
    index.delete([5])
    index.insert(numbers(spark, [(5, 50.0), (21, 21.0)]))
    expected = sorted([e for e in expected if e[0] != 5] + [(5, 50.0), (21, 21.0)])
    assert all_of(index) == expected
    assert index.compact(2) and all_of(index) == expected  # the delete is carried along
    assert len(index.store.manifest()["segments"]) == 2
    with pytest.raises(ValueError):
        index.delete([1])
        index.compact(2)
    index.delete(list(range(10)))
    expected = [e for e in expected if e[0] >= 10]
    assert index.compact(3) and all_of(index) == expected
    assert len(index.store.manifest()["segments"]) == 1  # the deletes were applied
    index.cleanup()
    assert all_of(FieldIndex(spark, f"file://{tmp_path}/n", FieldSpec("n", "number"))) == expected
    info = index.info().first().asDict()
    assert (info["version"], info["entries"], info["pending_inserts"]) == (3, len(expected), 0)
    assert {r["status"] for r in index.integrity_check().collect()} == {"ok"}
    index.store.delete("segments")
    assert [r["status"] for r in index.integrity_check().collect()] == ["ok", "ok", "failed", *["skipped"] * 4]
    with pytest.raises(ValueError):
        index.insert(numbers(spark, [(1, float("nan"))]))


def test_compaction_changes_no_result(spark, tmp_path):
    rng = random.Random(42)
    index = FieldIndex(spark, f"file://{tmp_path}/b", FieldSpec("b", "bool"))
    kept: set[tuple[int, bool]] = set()
    for turn in range(6):
        new = [(rng.randrange(15), rng.random() < 0.5) for _ in range(8)]
        index.insert(spark.createDataFrame(new, "doc_id long, value boolean"))
        kept |= set(new)
        gone = rng.sample(range(15), 2)
        index.delete(gone)
        kept = {e for e in kept if e[0] not in gone}
        assert all_of(index) == sorted(kept)
        if turn % 2:
            index.compact(index.store.current() + 1)
            assert all_of(index) == sorted(kept)
    assert [r[0] for r in boolean.bool_filter(index.entries(), True, "asc").collect()] == sorted(d for d, v in kept if v)


def test_text_field_replaces_and_scores_stay(spark, tmp_path):
    index = FieldIndex(spark, f"file://{tmp_path}/t", FieldSpec("t", "text"))
    docs = lambda pairs: text_entries(spark.createDataFrame(pairs, "doc_id long, text string"), text.tokens)
    index.insert(docs([(1, "alpha beta"), (2, "alpha"), (3, "gamma gamma delta")]))
    index.insert(docs([(2, "beta beta")]))
    scores = lambda: {r[0]: round(r[1], 9) for r in text.search(index.text_index(), text.Search(("alpha", "beta"))).collect()}
    before = scores()
    fresh = text.TextIndex.of(spark.createDataFrame([(1, "alpha beta"), (2, "beta beta"), (3, "gamma gamma delta")], "doc_id long, text string"))
    assert before == {r[0]: round(r[1], 9) for r in text.search(fresh, text.Search(("alpha", "beta"))).collect()}
    index.compact(1)
    assert scores() == before
    index.insert(docs([(2, "beta beta")]))
    index.delete([3])
    after = scores()
    index.compact(2)
    assert scores() == after and set(after) == {1, 2}


def test_order_of_the_log_does_not_matter(spark):
    ops = spark.createDataFrame([(1, "insert", 1, 1.0), (2, "delete", 1, None), (3, "insert", 1, 2.0), (4, "insert", 2, 5.0), (5, "delete", 2, None)], "seq long, op string, doc_id long, value double")
    for order in (F.col("seq"), F.col("seq").desc(), F.rand(1)):
        assert [tuple(r) for r in live_view(ops.orderBy(order), FieldSpec("n", "number")).collect()] == [(1, 2.0, 3)]


def test_command_line(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/n"
    index = FieldIndex(spark, root, FieldSpec("n", "number"))
    assert cli.main(["number", "check", root], spark) == 1
    index.insert(numbers(spark, [(1, 1.0), (2, 2.0), (3, 3.0)]))
    index.compact(1)
    assert cli.main(["number", "check", root], spark) == 0
    capsys.readouterr()
    assert cli.main(["number", "filter", root, "--gte", "2", "--limit", "1", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"count": 2, "rows": [{"doc_id": 2, "value": 2.0}]}
    assert cli.main(["number", "info", root, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["entries"] == 3


def test_streaming(spark, tmp_path):
    index = FieldIndex(spark, f"file://{tmp_path}/n", FieldSpec("n", "number"))
    schema = "op string, doc_id long, value double"
    source = f"{tmp_path}/in"
    spark.createDataFrame([("insert", 1, 1.0), ("insert", 2, 2.0)], schema).coalesce(1).write.json(source)
    take = lambda df: df.select("doc_id", "value")
    stream = spark.readStream.schema(schema).json(source)
    stream_into(index, stream, take, f"{tmp_path}/cp").awaitTermination(120)
    spark.createDataFrame([("delete", 1, None), ("insert", 3, 3.0)], schema).coalesce(1).write.mode("append").json(source)
    stream_into(index, stream, take, f"{tmp_path}/cp", compact_every=1).awaitTermination(120)
    assert all_of(index) == [(2, 2.0), (3, 3.0)] and index.store.current() == 1
    append_batch(index, spark.createDataFrame([("insert", 9, 9.0)], schema), 1, take)  # delivered again
    assert all_of(index) == [(2, 2.0), (3, 3.0)]


@pytest.mark.parametrize("fails_at", ["delete", "insert"])
def test_a_micro_batch_that_failed_is_appended_once(spark, tmp_path, fails_at, monkeypatch):
    root = f"file://{tmp_path}/g"
    index = FieldIndex(spark, root, FieldSpec("g", "geo"))
    rows = spark.createDataFrame([("insert", 1, 1.0, 2.0), ("delete", 5, None, None), ("insert", 5, 5.0, 5.0)], "op string, doc_id long, lat double, lon double")
    take = lambda df: df.select("doc_id", "lat", "lon")
    index.insert(take(rows.where("doc_id = 5")).where("lat is not null"))

    def fail(*args, **kwargs):
        raise OSError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(FieldIndex, fails_at, fail)
        with pytest.raises(OSError):
            append_batch(index, rows, 0, take)
    assert index.compact(1)  # covers nothing that is still to come
    index.insert(spark.createDataFrame([(9, 9.0, 9.0)], "doc_id long, lat double, lon double"))  # another writer between
    for _ in range(2):
        append_batch(FieldIndex(spark, root, FieldSpec("g", "geo")), rows, 0, take)
    assert all_of(index) == [(1, 1.0, 2.0), (5, 5.0, 5.0), (9, 9.0, 9.0)]
    assert index.compact(2) and all_of(index) == [(1, 1.0, 2.0), (5, 5.0, 5.0), (9, 9.0, 9.0)]
    append_batch(index, rows, 0, take)
    assert all_of(index) == [(1, 1.0, 2.0), (5, 5.0, 5.0), (9, 9.0, 9.0)]


def test_a_batch_counts_once_it_is_whole(spark, tmp_path):
    index = FieldIndex(spark, f"file://{tmp_path}/n", FieldSpec("n", "number"))
    index.insert(numbers(spark, [(1, 1.0)]))
    index.store.delete("ops", "seq=1", "_SUCCESS")
    assert all_of(index) == [] and index.compact(1) is False
    assert index.insert(numbers(spark, [(2, 2.0)])) == 2 and all_of(index) == [(2, 2.0)]


def test_pointers_are_never_replaced(spark, tmp_path):
    index = FieldIndex(spark, f"file://{tmp_path}/n", FieldSpec("n", "number"))
    for version in (1, 2, 12):
        index.insert(numbers(spark, [(version, 1.0)]))
        index.compact(version)
    assert index.store.current() == 12 and len(index.store.pointers()) == 3
    index.cleanup()
    assert index.store.current() == 12 and len(index.store.pointers()) == 1 and len(all_of(index)) == 3
    index.store.write("9\n", "current", f"{13:020d}")
    with pytest.raises(ValueError):
        index.store.current()
    assert index.integrity_check().first()["status"] == "failed"


def test_format_1_is_read_and_migrated(spark, tmp_path):
    index = FieldIndex(spark, f"file://{tmp_path}/t", FieldSpec("t", "text"))
    docs = lambda pairs: text_entries(spark.createDataFrame(pairs, "doc_id long, text string"), text.tokens)
    index.insert(docs([(1, "alpha beta"), (2, "alpha gamma gamma")]))
    index.compact(1)
    scores = lambda: {r[0]: round(r[1], 9) for r in text.search(index.text_index(), text.Search(("alpha", "gam"), tolerance=None)).collect()}
    before, m = scores(), index.store.manifest()
    index.store.save_manifest(m | {"segments": [{k: s[k] for k in ("path", "rows")} for s in m["segments"]]})
    index.store.delete("current")
    index.store.delete("lengths")
    index.store.delete("terms")
    index.store.write("1\n1\n", "CURRENT")
    assert index.store.current() == 1 and scores() == before and {r["status"] for r in index.integrity_check().collect()} == {"ok"}
    index.insert(docs([(3, "delta")]))
    assert index.compact(2) and index.store.current() == 2 and "lengths" in index.store.manifest()["segments"][0]
    index.cleanup()
    assert not index.store.exists("CURRENT") and set(scores()) == set(before)
    index.store.delete("current")
    index.store.write("7\n1\n", "CURRENT")
    with pytest.raises(ValueError):
        index.store.current()


def test_integrity_finds_disorder_and_bad_tombstones(spark, tmp_path):
    index = FieldIndex(spark, f"file://{tmp_path}/n", FieldSpec("n", "number"))
    index.insert(numbers(spark, [(i, float(i % 7)) for i in range(100)]))
    index.compact(1)
    status = lambda: {r["check"]: r["status"] for r in index.integrity_check().collect()}
    assert set(status().values()) == {"ok"}
    m = index.store.manifest()
    path = index.store.save(index.store.table(index.entry_schema, m["segments"][0]["path"]).orderBy(F.col("value").desc()).coalesce(1), "segments", [])
    index.store.save_manifest(m | {"segments": [{"path": path, "rows": 100}]})
    assert status()["order"] == "failed" and status()["tombstones"] == "skipped"
    marks = index.store.save(spark.createDataFrame([(1, 99)], "doc_id long, seq long"), "tombstones", [])
    index.store.save_manifest(m | {"tombstones": marks})
    assert status()["tombstones"] == "failed"


def test_compactions_by_kind(spark, tmp_path):
    """Points merge the smaller half of their segments; texts are merged into the last segment up to its bound."""
    geo_index = FieldIndex(spark, f"file://{tmp_path}/g", FieldSpec("g", "geo"), max_segments=3)
    with pytest.raises(ValueError):
        geo_index.info()
    point = lambda ids: spark.createDataFrame([(i, float(i % 80), 1.0) for i in ids], "doc_id long, lat double, lon double")
    for version, n in enumerate((50, 5, 20, 3), 1):
        geo_index.insert(point(range(100 * version, 100 * version + n)))
        geo_index.compact(version)
    assert [s["rows"] for s in geo_index.store.manifest()["segments"]] == [50, 28]  # 5 and 20 with the new 3
    assert len(all_of(geo_index)) == 78 and geo_index.info().first()["entries"] == 78
    text_index = FieldIndex(spark, f"file://{tmp_path}/t", FieldSpec("t", "text"), max_entries=12, deletion_threshold=0.9)
    docs = lambda ids: text_entries(spark.createDataFrame([(i, f"alpha b{i} alpha c") for i in ids], "doc_id long, text string"), text.tokens)
    for version, ids in enumerate(([1, 2], [3, 4], [5], [2]), 1):
        text_index.insert(docs(ids))
        text_index.compact(version)
    manifest = text_index.store.manifest()
    assert [s["rows"] for s in manifest["segments"]] == [12, 6] and manifest["tombstones"]
    found = text_index.text_index()
    assert sorted(map(tuple, found.lengths.collect())) == [(i, 4) for i in range(1, 6)] and found.stats().first()["n_tokens"] == 20
    fresh = text.TextIndex.of(spark.createDataFrame([(i, f"alpha b{i} alpha c") for i in range(1, 6)], "doc_id long, text string"))
    for request in (text.Search(("alpha", "b2")), text.Search(("b",), tolerance=None), text.Search(("b2x",), tolerance=1), text.Search(("alpha", "c"), phrase_boost=2.0)):
        scores = lambda i: {r[0]: round(r[1], 9) for r in text.search(i, request).collect()}  # noqa: E731, B023
        assert scores(found) == scores(fresh) != {}
    vectors = FieldIndex(spark, f"file://{tmp_path}/v", FieldSpec("v", "vector", dim=2), max_entries=4)
    for version, ids in enumerate(([1, 2], [3], [1, 4]), 1):
        vectors.insert(spark.createDataFrame([(i, 0, [float(i), float(version)]) for i in ids], "doc_id long, ord int, vec array<float>"))
        vectors.compact(version)
        assert {r["status"] for r in vectors.integrity_check().collect()} == {"ok"}
    assert sorted((r["doc_id"], r["vec"][1]) for r in vectors.entries().collect()) == [(1, 3.0), (2, 1.0), (3, 2.0), (4, 3.0)]
    assert vectors.info().first()["dim"] == 2


def test_ids_above_the_signed_range(spark, tmp_path):
    top = (1 << 64) - 1
    index = FieldIndex(spark, f"file://{tmp_path}/b", FieldSpec("b", "bool", ids="decimal"))
    index.insert(spark.createDataFrame([(str(top), True), (str(top - 1), True), ("0", True)], "doc_id string, value boolean"))
    index.delete([top - 1])
    assert sorted(int(r[0]) for r in boolean.bool_filter(index.entries(), True).collect()) == [0, top]
    index.compact(1)
    index.delete([0])
    assert sorted(int(r[0]) for r in boolean.bool_filter(index.entries(), True).collect()) == [top]


def test_a_token_without_a_stem_has_no_null_term(spark):
    docs = spark.createDataFrame([(1, "run running"), (2, "xyz")], "doc_id long, text string")
    index = text.TextIndex.of(docs, stemmer=lambda t: F.when(F.startswith(t, F.lit("run")), F.lit("run")))
    assert index.postings().where("term is null").count() == 0
    assert sorted((r["term"], list(r["exact"]), list(r["stemmed"])) for r in index.postings().where("doc_id = 1").collect()) == [("run", [0], [0, 1]), ("running", [1], [])]


def test_command_line_for_points(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/g"
    FieldIndex(spark, root, FieldSpec("g", "geo")).insert(spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0)], "doc_id long, lat double, lon double"))
    for options, ids in ((["--polygon", "0,0;0,2;2,2;2,0"], [1]), (["--polygon", "0,0;0,2;2,2;2,0", "--outside"], [2]), (["--box", "4,6,4,6", "--outside"], [1]), (["--radius", "5,5,1000"], [2])):
        capsys.readouterr()
        assert cli.main(["geo", "filter", root, *options, "--json"], spark) == 0
        assert [r["doc_id"] for r in json.loads(capsys.readouterr().out)["rows"]] == ids


def test_nearest_neighbours_exchange_only_what_tasks_keep(spark):
    entries = spark.range(1000).select((F.col("id") % 300).alias("doc_id"), (F.col("id") / 300).cast("int").alias("ord"), F.array(*[(F.col("id") * k % 17).cast("float") for k in (1, 2, 3)]).alias("vec"))
    found = vector.knn(entries, [1.0, 2.0, 3.0], 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("TakeOrderedAndProject") < plan.index("HashAggregate") and plan.count("TakeOrderedAndProject") == 2
    want = {}
    for r in entries.collect():
        d = sum((a - b) ** 2 for a, b in zip(r["vec"], [1.0, 2.0, 3.0], strict=True))
        want[r["doc_id"]] = min(want.get(r["doc_id"], d), d)
    assert [tuple(r) for r in found.collect()] == sorted(want.items(), key=lambda x: (x[1], x[0]))[:7]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_recall_of_the_approximate_index(spark, tmp_path, metric):
    entries = ingest.vector_entries(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding"), 64).cache()
    index = AnnIndex.build(entries, f"file://{tmp_path}/a", metric)
    hits = 0
    for q in entries.where("doc_id % 100 = 0").select("vec").collect():
        exact = {r[0] for r in vector.knn(entries, list(q[0]), 10, metric, per_document=1).collect()}
        found = {r[0] for r in index.search(list(q[0]), 10).collect()}
        assert len(found) == 10
        hits += len(exact & found)
    assert hits >= 0.9 * 10 * entries.where("doc_id % 100 = 0").count()
    with pytest.raises(ValueError):
        index.search([1.0], 3)


def test_byte_distances_follow_the_exact_ones(spark):
    rows = spark.createDataFrame([([1, -2, 127],), ([0, 0, 0],), ([-127, 5, 9],)], "codes array<tinyint>")
    query = [3, -4, 100]
    got = rows.select(*[f(F.col("codes"), query).alias(n) for n, f in I8_METRICS.items()]).collect()
    for (codes,), r in zip([([1, -2, 127],), ([0, 0, 0],), ([-127, 5, 9],)], got, strict=True):
        size = sum(a * a for a in codes) * sum(b * b for b in query)
        product = sum(a * b for a, b in zip(codes, query, strict=True))
        assert r["l2"] == sum((a - b) ** 2 for a, b in zip(codes, query, strict=True)) and r["dot"] == -product
        assert abs(r["cosine"] - (1 - product / size**0.5 if size else 1.0)) < 1e-12
    low, high = [-1.0, 0.0, 5.0], [1.0, 2.0, 5.0]
    for v in ([0.3, 1.9, 5.0], [-3.0, 9.0, 5.5]):
        column = spark.range(1).select(quantised(F.array(*map(F.lit, v)), F.array(*map(F.lit, low)), F.array(*map(F.lit, high)))).first()[0]
        assert list(column) == quantise(v, low, high)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_text_segment_takes_in_a_good_share_of_new_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(plan.MERGED_UP_TO, "text", 4)
    index = FieldIndex(spark, f"file://{tmp_path}/t", FieldSpec("t", "text"))
    docs = lambda ids: text_entries(spark.createDataFrame([(i, f"alpha b{i} alpha c") for i in ids], "doc_id long, text string"), text.tokens)
    index.insert(docs(range(10)))
    index.compact(1)
    index.delete([50])
    index.insert(docs([20, 21]))
    index.compact(2)
    info = index.info().first()
    assert (info["segments"], info["deleted"], info["entries"], info["documents"], info["unique_terms"]) == (1, 0, 36, 12, 14)
    index.insert(docs([30]))
    index.compact(3)
    assert [s["rows"] for s in index.store.manifest()["segments"]] == [36, 3]  # more than ten times as large


def test_entries_of_a_text_field_are_not_exchanged(spark, tmp_path, monkeypatch):
    index = FieldIndex(spark, f"file://{tmp_path}/t", FieldSpec("t", "text"))
    docs = lambda pairs: text_entries(spark.createDataFrame(pairs, "doc_id long, text string"), text.tokens)
    assert "Generate" not in planned(docs([(1, "a")]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.insert(docs([(1, "alpha beta"), (2, "alpha"), (3, "gamma gamma delta"), (4, "")]))
        assert "Exchange" not in planned(index._live(0))
        index.delete([2])
        assert "SortMergeJoin" not in planned(index._live(0)) and "BroadcastHashJoin" in planned(index._live(0))
        monkeypatch.setattr(plan, "SENT_UP_TO", 0)  # too many ids to be sent: the same rows by an exchange
        assert "SortMergeJoin" in planned(index._live(0))
        want = [(1, "alpha"), (1, "beta"), (3, "delta"), (3, "gamma"), (4, None)]
        assert sorted(((r[0], r[1]) for r in index.entries().collect()), key=str) == sorted(want, key=str)
        index.compact(1)
        monkeypatch.undo()
        index.insert(docs([(1, "beta"), (5, "alpha")]))
        index.insert(docs([(5, "delta zeta")]))
        before = sorted(((r[0], r[1]) for r in index.entries().collect()), key=str)
        assert before == sorted([(1, "beta"), (3, "delta"), (3, "gamma"), (4, None), (5, "delta"), (5, "zeta")], key=str)
        index.compact(2)
        assert sorted(((r[0], r[1]) for r in index.entries().collect()), key=str) == before
        assert index.text_index().stats().first()["n_docs"] == 4 and {r["status"] for r in index.integrity_check().collect()} == {"ok"}
        found = text.search(index.text_index(), text.Search(("d", "gam"), tolerance=None))
        assert "SortMergeJoin" not in planned(index.text_index().postings_where(lambda t: F.startswith(t, F.lit("d")))) and {r[0] for r in found.collect()} == {3, 5}
        assert "left_semi" not in planned(found).lower() and "LeftSemi" not in planned(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("stem", [False, True])
def test_postings_made_in_rows_are_those_of_single_tokens(spark, stem, monkeypatch):
    """Empty and null texts, an id of several texts, words beyond ASCII, slices of few tokens."""
    monkeypatch.setattr(postings, "AT_ONCE", 3)
    rows = [(3, "b a b"), (1, "a a runs run"), (2, ""), (4, None), (1, "runs c a"), (7, "ä z Ä \U0001f600"), (5, " \n"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stemmer = (lambda t: F.when(F.endswith(t, F.lit("s")), F.regexp_replace(t, "s$", ""))) if stem else None
    index = text.TextIndex.of(docs, stemmer=stemmer)
    plain = lambda df: sorted((tuple(r) for r in df.select("term", "doc_id", "exact", "stemmed", "field_length").collect()), key=str)
    each = index.postings_where(lambda t: F.lit(True))
    longest = {None: 1, 1: 4, 3: 3, 7: 4}
    want = sorted(((t, d, e, s, longest[d]) for t, d, e, s, _ in plain(each)), key=str)
    assert plain(index.postings()) == want
    assert sorted(r["doc_id"] for r in index.whole(True).where("term is null").collect()) == [2, 5]
    assert "Generate" not in planned(index.postings())


def test_order_is_checked_where_rows_are_read():
    rng = random.Random(5)
    rows = [(f, i, rng.choice([None, "a", "b", "ä"]), rng.randrange(3)) for f in (1, 2) for i in range(60)]
    before = lambda k: (k[0] is not None, (k[0] or "").encode(), k[1])
    want = sum(a[0] == b[0] and before(a[2:]) > before(b[2:]) for a, b in zip(rows, rows[1:], strict=False))
    batch = pa.RecordBatch.from_pylist([{"k": k, "n": n, "file": f, "at": i} for f, i, k, n in rows])
    (out,) = runs(iter([batch]), ["k", "n"])
    assert sum(out.column("wrong").to_pylist()) == want > 0
    assert [(r["file"], r["at"], r["last"]) for r in out.to_pylist()] == [(1, 0, False), (2, 0, False), (1, 59, True), (2, 59, True)]
    parts = [b for start in range(0, 120, 7) for b in runs(iter([batch.slice(start, 7)]), ["k", "n"])]
    assert sum(sum(b.column("wrong").to_pylist()) for b in parts) < want  # what lies between two batches is left to their ends
