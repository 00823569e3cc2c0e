"""Content-addressed WARC archive.

Two tables in one folder: ``headers`` holds the exact header block of every
record (a text in the WARC 1.1 layout), ``payloads`` holds each distinct
payload once under its SHA-256. Both the original payload rows and the whole
record bytes come back by joining the two tables on the digest.

Writing: rows are reduced to (digest, sizes, largest id) with partial
aggregation, so a payload that fills a third of the table leaves each task
once; the joins back carry digests, not payloads. Of records with equal
payloads of at least ``min_bytes`` that with the largest id is ``response``
and the others are ``revisit``; smaller payloads are always ``response``.
A digest that stands for payloads of different SHA-1 or length fails the job.

Rows: a null payload is empty, a null id sorts before all others and gets no
``refers_to`` of its own; rows that repeat an id with an equal payload make one
``response`` each if the id is the largest. Null or odd URLs are percent-coded
by the header only in CR and LF. Extra columns are ignored. Empty tables make
an empty archive; very long payloads are kept and read whole. Input columns may
have any names: only the three that are named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alphabet of RFC 4648 base32, line end, version line and field names of WARC 1.1.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are 4 groups of 40 bits, 8 characters of 5 bits each."""
    digits = F.sha1(data)
    chars = []
    for group in range(4):
        bits = F.conv(F.substring(digits, 1 + 10 * group, 10), 16, 10).cast("long")
        for k in range(8):
            index = F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int")
            chars.append(F.element_at(F.lit(list(BASE32)), index + 1))
    return F.concat(*chars)


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def _header_block(min_bytes: int) -> Column:
    """The header lines of a record, each ended by CRLF, and the empty line."""
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("uri", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(VERSION + CRLF),
        F.lit("WARC-Type: "), F.col("record_type"), F.lit(CRLF),
        F.lit("WARC-Record-ID: "), _record_id(F.col("record_id")), F.lit(CRLF),
        F.lit("WARC-Target-URI: "), uri, F.lit(CRLF),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + CRLF),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(CRLF),
                                 F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html" + CRLF),
        F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(CRLF + CRLF))


def write(records: DataFrame, path: str, key: str, uri: str, payload: str, min_bytes: int = 0) -> str:
    """Write the archive of ``records`` under ``path`` (a shared folder) and return ``path``."""
    spark = records.sparkSession
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = records.select(F.col(f"`{key}`").cast("long").alias("record_id"),
                          F.col(f"`{uri}`").cast("string").alias("uri"), body.alias("payload")) \
        .withColumn("address", F.sha2("payload", 256))
    # each distinct payload once: equal payloads meet in the map-side aggregation first
    stored = rows.groupBy("address").agg(
        F.first("payload").alias("payload"), F.max("record_id").alias("largest_id"),
        F.min(F.sha1("payload")).alias("low"), F.max(F.sha1("payload")).alias("high"),
        F.min(F.length("payload")).alias("short"), F.max(F.length("payload")).alias("long"))
    same = (F.col("low") == F.col("high")) & (F.col("short") == F.col("long"))
    stored.select(F.when(same, F.col("address")).otherwise(F.raise_error(F.lit("two payloads share a digest")))
                  .alias("address"), "payload", "largest_id", base32_sha1(F.col("payload")).alias("payload_digest"),
                  F.length("payload").cast("long").alias("payload_bytes")) \
        .write.mode("error").parquet(f"{path}/payloads")
    index = spark.read.parquet(f"{path}/payloads").drop("payload")
    typed = rows.drop("payload").join(index, "address", "left").withColumn(
        "record_type", F.when((F.col("payload_bytes") >= min_bytes)
                              & ~F.col("record_id").eqNullSafe(F.col("largest_id")), "revisit").otherwise("response")) \
        .withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("largest_id")))
    typed.select("record_id", "address", _header_block(min_bytes).alias("header")) \
        .write.mode("error").parquet(f"{path}/headers")
    return path


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each checked against its address."""
    stored = spark.read.parquet(f"{path}/payloads").select("address", "payload")
    good = F.sha2("payload", 256) == F.col("address")
    return stored.select("address", F.when(good, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "address")).cast("binary")).alias("payload"))


def _field(name: str) -> Column:
    """Value of a header field, null where the block has none."""
    value = F.regexp_extract("header", rf"(?md)^{name}: (.*)\r$", 1)
    return F.when(F.contains(F.col("header"), F.lit(f"{CRLF}{name}: ")), value)


def _number(field: str) -> Column:
    return F.regexp_extract(_field(field), r"<urn:record:(-?\d+)>", 1).try_cast("long")


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the header blocks and the checked payloads: id, URI, size and digest of the full
    payload, type, and the record a revisit refers to. Payload facts are taken once per stored payload; a header whose
    digest or length is not its payload's fails the job."""
    facts = payloads(spark, path).select("address", F.length("payload").cast("long").alias("payload_bytes"),
                                         base32_sha1(F.col("payload")).alias("payload_digest"))
    heads = spark.read.parquet(f"{path}/headers").select(
        "address", _number("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("uri"),
        _field("WARC-Type").alias("record_type"), _number("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest").alias("digest"), _field("Content-Length").alias("length"))
    joined = heads.join(facts, "address")
    body = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    true = (F.col("digest") == F.concat(F.lit("sha1:"), "payload_digest")) & (F.col("length") == body.cast("string"))
    checked = F.when(F.coalesce(true, F.lit(False)), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(
        F.lit("header is not its payload's: "), F.coalesce(F.col("record_id").cast("string"), F.lit("null")))).cast("long"))
    return joined.select("record_id", "uri", checked.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: id, header block, full payload, and the bytes of the WARC record (a revisit's has no
    body)."""
    heads = spark.read.parquet(f"{path}/headers").withColumn("record_id", _number("WARC-Record-ID"))
    joined = heads.join(payloads(spark, path), "address")
    body = F.when(_field("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.select("record_id", "header", "payload",
                         F.concat(F.col("header").cast("binary"), body, F.lit(CRLF * 2).cast("binary"))
                         .alias("record"))
