"""Field operators on small fixtures with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import geo as G
from sieveline.functions import vectors as V
from sieveline.operators import boolean, geo, ids, keys, number, text, vector
from sieveline.sources import ingest


def rows(df):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.collect()]


def test_bool(spark):
    e = spark.createDataFrame([(1, True), (2, False), (3, True), (3, False), (3, True), (4, None)], "doc_id long, value boolean")
    assert rows(boolean.bool_filter(e, True, "desc")) == [3, 1]
    assert rows(boolean.bool_sort(e)) == [(2, False), (3, False), (1, True), (3, True)]
    assert rows(boolean.bool_sort(e, True)) == [(3, True), (1, True), (3, False), (2, False)]


def test_number_total_order(spark):
    e = spark.createDataFrame([(1, float("-inf")), (2, -0.0), (3, 0.0), (4, float("inf")), (5, 1.5), (6, -2.0)], "doc_id long, value double")
    found = lambda op, *b: sorted(r[0] for r in number.number_filter(e, op, *b).collect())
    assert (found("eq", 0.0), found("eq", -0.0)) == ([3], [2])
    assert (found("gt", -0.0), found("gte", 0.0), found("lt", 0.0), found("lte", -0.0)) == ([3, 4, 5], [3, 4, 5], [1, 2, 6], [1, 2, 6])
    assert found("between", -2.0, 0.0) == [2, 3, 6] and found("between", 2.0, -2.0) == []
    assert [r[0] for r in rows(number.number_sort(e))] == [1, 6, 2, 3, 5, 4]
    assert [r[0] for r in rows(number.number_sort(e, True))] == [4, 5, 3, 2, 6, 1]
    assert [r[1] for r in rows(number.number_sort_grouped(e))] == [[1], [6], [2], [3], [5], [4]]
    with pytest.raises(ValueError):
        number.predicate("eq", math.nan)


def test_number_arrays_repeat(spark):
    e = spark.createDataFrame([(1, 10), (2, 20), (1, 30), (3, 10)], "doc_id long, value long")
    assert [r[0] for r in rows(number.number_sort(e))] == [1, 3, 2, 1]
    assert rows(number.number_sort_grouped(e)) == [(10, [1, 3]), (20, [2]), (30, [1])]
    assert rows(number.number_sort_grouped(e, True)) == [(30, [1]), (20, [2]), (10, [3, 1])]
    assert sorted(rows(number.number_filter(e, "gte", 10))) == [(1, 10), (1, 30), (2, 20), (3, 10)]


def test_keys_and_ids(spark):
    e = spark.createDataFrame([(1, "hello"), (2, "world"), (3, "hello"), (4, ""), (5, "été"), (6, None)], "doc_id long, key string")
    assert sorted(rows(keys.key_filter(e, "hello"))) == [1, 3] and rows(keys.key_filter(e, "")) == [4]
    assert rows(keys.key_enumerate(e)) == ["", "hello", "world", "été"]
    a, b = e.where("doc_id < 4").select("doc_id"), e.where("doc_id > 2").select("doc_id")
    assert sorted(rows(ids.ids_union(a, b))) == [1, 2, 3, 4, 5, 6]
    assert (sorted(rows(ids.ids_except(a, b))), rows(ids.ids_intersect(a, b))) == ([1, 2], [3])


def test_geo_complements_and_brute_force(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [(1, 0.0, 0.0), (400, 90.0, 180.0), (401, -90.0, -180.0)]
    e = spark.createDataFrame(points, "doc_id long, lat double, lon double")
    polygon = [(-30.0, -40.0), (45.0, -55.0), (10.0, 5.0), (50.0, 60.0), (-25.0, 70.0)]
    for call in (lambda o: geo.geo_box(e, -20, 40, -100, 50, o), lambda o: geo.geo_radius(e, 80.0, 170.0, 3e6, o), lambda o: geo.geo_polygon(e, polygon, o)):
        assert call(False).count() + call(True).count() == len(points)

    def away(lat, lon):
        a = math.sin(math.radians(lat - 80) / 2) ** 2 + math.cos(math.radians(80)) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - 170) / 2) ** 2
        return 2 * G.EARTH_METRES * math.asin(math.sqrt(min(1, a)))

    assert sorted(rows(geo.geo_radius(e, 80.0, 170.0, 3e6))) == sorted(i for i, la, lo in points if away(la, lo) <= 3e6)
    assert geo.geo_box(e, -90, 90, 10, -10).count() == 0
    with pytest.raises(ValueError):
        G.in_polygon(F.lit(0.0), F.lit(0.0), [(0, 0), (1, 1)])
    code = e.select(F.max(F.abs(G.decode_lat(G.encode_lat(F.col("lat"))) - F.col("lat")))).first()[0]
    assert code < 1e-6 and geo.geo_box_quantised(e, -90, 90, -180, 180).count() == len(points)


def test_vectors(spark):
    data = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [3.0, 4.0, 0.0]), (4, [1.0, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, None)]
    e = ingest.vector_entries(spark.createDataFrame(data, "doc_id long, embedding array<float>"), 3)
    assert rows(vector.knn(e, [0.0, 0.0, 0.0], 5)) == [(1, 0.0), (2, 1.0), (3, 25.0)]
    assert rows(vector.knn(e, [1.0, 1.0, 0.0], 2, "dot")) == [(3, -7.0), (2, -1.0)]
    cosine = dict(rows(vector.knn(e, [2.0, 0.0, 0.0], 3, "cosine")))
    assert cosine[1] == 1.0 and abs(cosine[2]) < 1e-9 and abs(cosine[3] - 0.4) < 1e-9
    assert [d for _, d in rows(vector.knn(e, [0.0, 0.0, 0.0], 3, "cosine"))] == [1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        vector.knn(e, [1.0], 1, dim=3)
    assert rows(vector.knn(e, [0.0, 0.0, 0.0], 0)) == []
    # Unrolled and folded distances agree.
    unrolled = V.UNROLLED
    try:
        V.UNROLLED = 0
        assert rows(vector.knn(e, [1.0, 1.0, 0.0], 3, "l2")) == [(1, 2.0), (2, 1.0), (3, 13.0)][1::-1] + [(3, 13.0)]
    finally:
        V.UNROLLED = unrolled
    q = e.select(V.quantised(F.col("vec"), F.array(*[F.lit(0.0)] * 3), F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0))).alias("q")).collect()
    assert [list(r[0]) for r in q][2] == [127, 127, -127]


def test_bm25_against_the_formula(spark):
    docs = ["apple banana apple", "banana cherry", "application form", None, ""]
    e = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    index = text.TextIndex.of(e)
    assert tuple(index.stats().first())[:2] == (4, 7)
    got = dict(rows(text.search(index, text.Search(("apple",)))))
    average = 7 / 4
    ntf = 2 / (0.25 + 0.75 * 3 / average) * 3
    assert set(got) == {0} and abs(got[0] - math.log(1 + 3.5 / 1.5) * 2.2 * ntf / (1.2 + ntf)) < 1e-9
    assert {d for d, _ in rows(text.search(index, text.Search(("app",), tolerance=None)))} == {0, 2}
    assert {d for d, _ in rows(text.search(index, text.Search(("bananas",), tolerance=1)))} == {0, 1}
    assert rows(text.search(index, text.Search(()))) == [] and rows(text.search(index, text.Search(("none",)))) == []
    assert {d for d, _ in rows(text.search(index, text.Search(("apple", "banana"), min_match=2)))} == {0}
    twice = dict(rows(text.search(index, text.Search(("apple", "apple")))))
    assert abs(twice[0] - 2 * got[0]) < 1e-9


def test_phrases_and_stems(spark):
    e = spark.createDataFrame([(1, "hello world"), (2, "hello a b world"), (3, "runs running")], "doc_id long, text string")
    plain = dict(rows(text.search(text.TextIndex.of(e), text.Search(("hello", "world")))))
    phrase = dict(rows(text.search(text.TextIndex.of(e), text.Search(("hello", "world"), phrase_boost=2.0))))
    assert abs(phrase[1] / plain[1] - 3) < 1e-9 and abs(phrase[2] - plain[2]) < 1e-9
    stems = text.TextIndex.of(e, stemmer=lambda t: F.regexp_replace(t, "(ning|s)$", ""))
    assert {d for d, _ in rows(text.search(stems, text.Search(("run",))))} == {3}
    assert rows(text.search(stems, text.Search(("run",), exact_match=True))) == []


def test_json_types_are_strict(spark):
    def got(f, values, **options):
        df = spark.createDataFrame(list(enumerate(values)), "doc_id long, json string")
        return sorted(rows(f(df, **options)), key=str)

    assert got(ingest.bool_entries, ["true", '"true"', "1", "null", "[true]"]) == [(0, True)]
    assert got(ingest.bool_entries, ['[true,false,"x",true]', "[]", "true"], is_array=True) == [(0, False), (0, True)]
    assert got(ingest.number_entries, ["1", "1.0", '"1"', "-1", "true"], number="long") == [(0, 1), (3, -1)]
    assert got(ingest.number_entries, ["1", "1.5", '"1"', "[1]"]) == [(0, 1.0), (1, 1.5)]
    assert str(got(ingest.number_entries, ["-0.0"])) == "[(0, -0.0)]"
    assert [int(v) for _, v in got(ingest.number_entries, ["18446744073709551615", "-1"], number="decimal")] == [18446744073709551615]
    assert got(ingest.number_entries, ['[1,"x",3.5]', "[]"], is_array=True) == [(0, 1.0), (0, 3.5)]
    assert got(ingest.key_entries, ['"a"', '""', "1"]) == [(0, "a"), (1, "")]
    assert got(ingest.key_entries, ['["a",1,"b","a"]'], is_array=True, accepts=lambda k: k != "b") == [(0, "a")]
    assert got(ingest.text_values, ['["a b","c"]', '["a",1]'], is_array=True) == [(0, "a b c")]
    assert got(ingest.geo_entries, ['{"lat":1,"lon":2.5}', '{"lat":91,"lon":0}', '{"lat":"1","lon":0}', "{}"]) == [(0, 1.0, 2.5)]
    assert got(ingest.geo_entries, ['[{"lat":1,"lon":2},{"lat":null,"lon":1},{"lat":3,"lon":4}]'], is_array=True) == [(0, 1.0, 2.0), (0, 3.0, 4.0)]
