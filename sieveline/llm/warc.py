"""A content-addressed WARC archive: heads and payloads in separate tables.

``payloads`` (digest, payload) holds the bytes of each distinct payload once, under their SHA-256. ``heads`` (page_id,
digest, carries, head) holds each record's exact WARC and HTTP head. A record is its head and, where it carries one, its
payload; joining the two gives the original bytes back, and the digest is checked again on the way.

Of the records with equal payloads the one with the largest page_id is a response, the others are revisits that refer to
it. Null html counts as empty; a null url leaves the target out; null page_ids revisit a response that has one, and are
responses in a group without any. Rows that repeat a response's page_id and payload are responses too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import new_folder, rows_of, short_batches, table, written

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
#: Payloads shorter than this many bytes are not looked up: each of their records is a response.
LEAST_BYTES = 0


def base32_of_hex(hexadecimal: Column) -> Column:
    """Upper-case base32 of a 160-bit hexadecimal digest."""
    h = F.upper(hexadecimal)
    parts = [F.lpad(F.conv(F.substring(h, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def archive(pages: DataFrame, date: str = "2020-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(heads, payloads) of ``pages`` (page_id, url, html).

    Texts move once, to bring equal payloads together (combined before the exchange); otherwise only digests move.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    slim = written(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.col("url").cast("string").alias("url"),
            F.sha2(payload, 256).alias("digest"),
            base32_of_hex(F.sha1(payload)).alias("sha1"),
            F.octet_length(payload).cast("long").alias("size"),
        ),
        "digests",
    )
    # Only groups of two or more need a look-up; a very large group is one row here, and Spark splits the other side.
    groups = slim.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    copied = slim.join(groups.where("copies > 1").select("digest", "keeper"), "digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL * 2))
    head = F.concat(
        F.lit("WARC/1.1" + EOL),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", record_id(F.col("keeper"))), line("WARC-Profile", F.lit(REVISIT)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))).cast("string")),
        F.lit(EOL),
        http,
    )
    heads = copied.withColumn("revisit", revisit).select("page_id", "digest", (~F.col("revisit")).alias("carries"), head.alias("head"))
    payloads = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.any_value("payload").alias("payload"))
    return heads, payloads


def write_archive(pages: DataFrame, folder: str, **options) -> None:
    heads, payloads = archive(pages, **options)
    heads.write.option("compression", "zstd").parquet(f"{folder}/heads")
    payloads.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, head, payload, record): the original bytes. ``payload`` is null where the record carries none.

    Each payload joins the few records that carry it; revisits need no payload, so that no group of copies meets.
    """
    heads = spark.read.schema("page_id long, digest string, carries boolean, head string").parquet(f"{folder}/heads")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    found = heads.where("carries").join(payloads, "digest", "left")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("missing or damaged payload "), F.col("digest"))).cast("binary"))
    head = F.col("head").cast("binary")
    whole = found.select("page_id", "head", sound.alias("payload")).withColumn("record", F.concat(head, F.col("payload"), F.lit(EOL * 2).cast("binary")))
    bare = heads.where("not carries").select("page_id", "head", F.lit(None).cast("binary").alias("payload"), F.concat(head, F.lit(EOL * 2).cast("binary")).alias("record"))
    return whole.unionByName(bare)


def whole_pages(spark: SparkSession, folder: str, part: int = 10_000) -> DataFrame:
    """(page_id, head, payload) of all records: a revisit has the payload of the response that it refers to.

    A payload is copied once for each ``part`` of its records, so that those of a frequent one are dealt to several tasks."""
    heads = spark.read.schema("page_id long, digest string, carries boolean, head string").parquet(f"{folder}/heads")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    parts = heads.groupBy("digest").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    copies = payloads.join(parts, "digest").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    frequent = parts.where("parts > 1")
    dealt = heads.join(frequent, "digest", "left").withColumn("p", F.pmod(F.xxhash64("page_id", "head"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int"))
    return dealt.join(copies, ["digest", "p"]).select("page_id", "head", "payload")


def write_files(records: DataFrame, folder: str) -> DataFrame:
    """Archive files in WARC's own form: (path, n_records), written. Each record is a gzip member of its own; a task writes one
    file under a name of its attempt, and only files that are named in the result count."""
    short_batches(records.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        stream, n = None, 0
        for (found,) in rows_of(batches, "record"):
            if stream is None:
                store, top = fs.FileSystem.from_uri(folder)
                store.create_dir(top, recursive=True)
                name = f"pages-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
                stream = store.open_output_stream(f"{top}/{name}", compression=None)
            for record in found:
                stream.write(gzip.compress(record, 6, mtime=0))
            n += len(found)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return written(records.select("record").mapInArrow(run, "path string, n_records long"), "warc-files")


def parse_records(records: DataFrame) -> DataFrame:
    """What the records themselves say: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    head = F.col("head")
    field = lambda name, value: F.regexp_extract(head, rf"\r\n{name}: {value}\r\n", 1)
    page = lambda text: F.when(text == "none", None).otherwise(text).try_cast("long")
    told = field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")
    return records.select(
        page(field("WARC-Record-ID", r"<urn:x-page:([^>]*)>")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.regexp_extract(head, r"\r\n\r\nHTTP/1\.1 [^\x00]*\r\nContent-Length: ([0-9]+)\r\n\r\n$", 1).cast("long")).alias("payload_bytes"),
        F.coalesce(base32_of_hex(F.sha1("payload")), told).alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        page(field("WARC-Refers-To", r"<urn:x-page:([^>]*)>")).alias("refers_to"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return parse_records(read_records(spark, folder))


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper, sha1(coalesce(html, '')) AS h FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  translate(to_base(CAST('0x' || substr(h, 1, 15) AS BIGINT), 32, 12) || to_base(CAST('0x' || substr(h, 16, 15) AS BIGINT), 32, 12) || to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p
"""
