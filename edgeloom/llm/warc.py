"""Content-addressed WARC archive.

Payload bytes are stored once per content address (SHA-256, with SHA-1 and
length kept beside it and checked on reading); the exact header block of every
record is kept apart. Records are put together again by a join of headers and
payloads on the address.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import ensure_checkpoint_dir

CAPTURE_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are 8 groups of 20 bits, 4 base-32 digits each."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header() -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    # a line break inside a URL would end the header early
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", rid(F.col("page_id"))),
        line("WARC-Target-URI", uri), line("WARC-Date", F.lit(CAPTURE_DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", rid(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE)))
               ).otherwise(line("Content-Type", F.lit("text/html; charset=utf-8"))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  min_bytes: int = 0) -> None:
    """Write one WARC record per row of ``pages`` under ``path`` (headers/ and payloads/).

    Null bodies are empty payloads. Among equal payloads of ``min_bytes`` or
    more the smallest id is the response and the others revisit it; smaller
    payloads are all responses, which still share their stored bytes. Rows that
    repeat the smallest id are responses too; a null id ranks after all others.
    An empty table gives an empty archive; other columns are ignored.
    """
    rec = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rec = rec.select("page_id", "url", "payload", F.sha2("payload", 256).alias("address"),
                     base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("n"))
    narrow = rec.drop("payload")
    first = narrow.groupBy("address", "sha1", "n").agg(F.min("page_id").alias("first_id"))
    same = F.col("page_id").eqNullSafe(F.col("first_id"))
    last = F.lit(2**63 - 1)
    typed = narrow.join(first, ["address", "sha1", "n"]).withColumn(
        "record_type", F.when(same | (F.col("n") < min_bytes), "response").otherwise("revisit"))
    typed.select("page_id", "address", _header().alias("header")).write.mode("overwrite").parquet(f"{path}/headers")
    # only the first holder's bytes move; rows that repeat its id hold the same bytes
    own = rec.select("address", F.coalesce("page_id", last).alias("holder"), "payload").join(
        first.select("address", F.coalesce("first_id", last).alias("holder")), ["address", "holder"])
    own.dropDuplicates(["address", "holder"]).select("address", "payload").write.mode("overwrite").parquet(f"{path}/payloads")


def _verified(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with their facts; a payload that does not match its address is an error."""
    p = spark.read.parquet(f"{path}/payloads")
    return p.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address"))).cast("binary")))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    return spark.read.parquet(f"{path}/headers").select(
        "address", "header",
        F.expr(r"try_cast(regexp_extract(header, '\r\nWARC-Record-ID: <urn:page:(-?[0-9]*)>', 1) as bigint)").alias("page_id"),
        field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("stated_digest"),
        F.expr(r"try_cast(regexp_extract(header, '\r\nWARC-Refers-To: <urn:page:(-?[0-9]*)>', 1) as bigint)").alias("refers_to"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as written: page_id, record_type, refers_to, payload, record (header block and body)."""
    both = _parsed(spark, path).join(_verified(spark, path), "address")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select("page_id", "record_type", "refers_to", "payload",
                       F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per record the length and digest of its full payload, taken from the stored bytes.

    The bytes are read, checked and digested once each, before the join, so a
    payload that a third of all records share is not multiplied.
    """
    facts = _verified(spark, path).select("address", F.length("payload").cast("long").alias("payload_bytes"),
                                          base32_sha1(F.col("payload")).alias("payload_digest"))
    both = _parsed(spark, path).join(facts, "address")
    checked = F.when(F.col("stated_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")
                     ).otherwise(F.raise_error(F.lit("header and payload digest differ")))
    return both.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_digests(spark, path)


SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hx, min(page_id) OVER (PARTITION BY body) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(hx, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31)]),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM h
"""
