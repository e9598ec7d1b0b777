"""A content-addressed WARC archive.

Every page becomes a WARC record. Payload bytes are stored once per SHA-256, and the
exact header block of every record, up to the payload, is stored apart with that digest.
Equal digests are verified: all payloads of a digest must agree in length and SHA-1. The
records' bytes are put together again by a join of both tables, and every digest is
computed anew from the bytes read. Of records with equal payloads of at least
``least_bytes`` bytes the one with the largest id is the response, the others revisit it.

Defined cases: a null payload is empty. A null id is smaller than all others; its record
ID is empty, and a payload that only null ids have is a response for each of them.
Repeated rows of the responding id are responses too. A null address leaves out the
header; line breaks in an address are percent-encoded, as a header is one line. Columns
but the named are ignored. All work is built-in functions; only digests and ids are
shuffled to find the responses, payloads once to store and once to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.sources.shared_storage import new_folder

# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
ID_PREFIX = "urn:page:"


def sha1_base32(data: Column) -> Column:
    """Base32 of the SHA-1, by fives of hexadecimal digits."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _header_block(date: str) -> Column:
    """All bytes of a record before its payload, as text."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), address), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(
            revisit,
            F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("owner"))),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit("\r\n\r\n"), http,
    )


def write_archive(
    pages: DataFrame,
    path: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> str:
    """Writes ``payloads`` and ``headers`` below ``path`` (the shared folder if none)."""
    path = path or new_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digested = rows.withColumn("digest", F.sha2("payload", 256))
    facts = digested.select(
        "page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
    )
    differ = (F.min("payload_bytes") != F.max("payload_bytes")) | (F.min("payload_digest") != F.max("payload_digest"))
    owners = facts.groupBy("digest").agg(
        F.max("page_id").alias("owner"),
        F.when(differ, F.raise_error(F.lit("payloads of one digest differ"))).otherwise(F.lit(True)).alias("verified"),
    )
    response = (F.col("payload_bytes") < least_bytes) | F.col("owner").isNull() | F.col("page_id").eqNullSafe(F.col("owner"))
    records = facts.join(owners, "digest").where("verified").withColumn(
        "record_type", F.when(response, "response").otherwise("revisit")
    )
    # Partial aggregation leaves one copy per task before the shuffle, however many there are.
    (
        digested.groupBy("digest").agg(F.first("payload").alias("payload"))
        .write.option("compression", "zstd").parquet(f"{path}/payloads")
    )
    records.select("digest", _header_block(date).alias("header")).write.parquet(f"{path}/headers")
    return path


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def _id_in(name: str) -> Column:
    found = F.regexp_extract(_field(name), rf"<{ID_PREFIX}(.*)>", 1)
    return F.when(found != "", found).cast("long")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Of each record its fields, ``header`` and ``digest``."""
    return spark.read.parquet(f"{path}/headers").select(
        _id_in("WARC-Record-ID").alias("page_id"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _id_in("WARC-Refers-To").alias("refers_to"),
        _field("Content-Length").cast("long").alias("block_bytes"),
        "header", "digest",
    )


def records(spark: SparkSession, path: str, resolve: bool = False) -> DataFrame:
    """The fields of each record and its bytes, ``record``, put together by a join.

    A revisit has no payload of its own; with ``resolve`` it gets the one it refers to.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    found = headers(spark, path)
    if not resolve:
        found = found.where(F.col("record_type") == "response")
    joined = found.join(payloads, "digest").withColumn(
        "record", F.concat(F.col("header").cast("binary"), F.col("payload"), F.lit(RECORD_END).cast("binary"))
    ).drop("payload")
    if resolve:
        return joined
    bare = headers(spark, path).where(F.col("record_type") != "response").withColumn(
        "record", F.concat(F.col("header").cast("binary"), F.lit(RECORD_END).cast("binary"))
    )
    return joined.unionByName(bare)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the records.

    Lengths and digests are those of the payloads read; a payload whose digest is not the
    one in its header fails the job.
    """
    found = records(spark, path).where(F.col("record_type") == "response")
    size = F.octet_length("record") - F.octet_length("header") - len(RECORD_END)
    payload = F.substring(F.col("record"), F.octet_length("header") + 1, size)
    read = found.select(
        "page_id", "digest", "record_type", "refers_to", F.octet_length(payload).cast("long").alias("payload_bytes"),
        sha1_base32(payload).alias("payload_digest"), F.col("payload_digest").alias("_said"),
        (F.sha2(payload, 256) == F.col("digest")).alias("_same"),
    )
    good = F.col("_same") & (F.col("payload_digest") == F.col("_said"))
    responses = read.withColumn(
        "payload_digest",
        F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload is damaged"))),
    )
    facts = responses.groupBy("digest").agg(
        F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")
    )
    revisits = (
        headers(spark, path).where(F.col("record_type") == "revisit")
        .select("page_id", "digest", "record_type", "refers_to").join(facts, "digest")
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.select(*columns))
