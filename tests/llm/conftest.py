import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def rows_of():
    """Rows of one of the smallest tables, by plain DuckDB."""

    def read(name, columns):
        return duckdb.sql(f"select {columns} from read_parquet('{DATA}/{name}.parquet') order by 1").fetchall()

    return read


#: Texts that every operator must survive.
ODD = [
    None, "", " ", "\n\t", "a", "word", "Ünïcödé ÄÖÜ ß", "日本語のテキスト", "a\x00b", " mark .", "emoji 👩‍👩‍👧 \U0001F600", "x" * 5_000,
    "one two three four five six " * 900, "'s 't it's", "<|endoftext|> <|startoftext|>", "\x1c\x1d\x85\xa0 odd spaces 　", "1234567890" * 40, "!?" * 500, "é combining",
]


@pytest.fixture
def odd(spark):
    """Odd texts with null and repeated ids, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{i}", 7, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "s", 7, "k"), (5, ODD[5], None, None, None, None), (None, "no id", None, None, None, None), (None, None, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, k string"
    df = spark.createDataFrame(rows, columns)
    for name in ("t", "row", "range", "halo", "digest", "kept_doc_id", "span_doc_id", "component_id", "g", "score", "kept", "page_id"):
        df = df.withColumn(name, df["k"])
    return df


@pytest.fixture
def none(odd):
    return odd.where("false")
