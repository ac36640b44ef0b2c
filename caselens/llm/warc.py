"""Content-addressed web archive: payloads once by strong digest, record headers apart, joined on reading.

An archive is a folder with two Parquet tables. `payloads` has each distinct payload once under its SHA-256.
`headers` has one row per record with the exact header bytes and the digest of its payload. A response record
is its header, payload and two line ends; a revisit record has no payload of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Record layout of WARC 1.1 and the alphabet of RFC 4648 base32.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORD_END = "\r\n\r\n"


def base32_of_hex(digest: Column, hex_digits: int = 40) -> Column:
    """RFC 4648 base32 of a hex digest whose length is a multiple of five digits."""
    parts = [
        F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, hex_digits + 1, 5)
    ]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")


def _uri(column: Column) -> Column:
    """A header value may not hold line ends or other controls: they are percent-encoded."""
    out = column
    for code in (*range(32), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def write_archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    revisit_from: int = 0,
) -> None:
    """Writes one record per page row below `path`.

    Among rows with the same payload of at least `revisit_from` bytes, the one with the smallest id is the
    response and the others revisit it; rows that repeat the smallest id with the same payload are responses
    too, and so is every row whose payload only rows without an id have. Shorter payloads are all responses.
    A null payload is the empty one; a null url or id leaves its header line out. Each distinct payload is
    stored once: each task sends a payload at most once, and only digests and ids are joined.
    """
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), data.alias("payload")
    ).withColumns({"sha256": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    light = rows.withColumn("sha1", F.sha1("payload")).drop("payload")
    first = light.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    linked = light.join(first, "sha256")
    revisit = (
        (F.col("payload_bytes") >= revisit_from) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    )
    kind = F.when(revisit, "revisit").otherwise("response")
    refers = F.when(revisit, F.col("first_id"))
    body = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", kind),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\n"))).otherwise(""),
        _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(refers.isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">\r\n"))).otherwise(""),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", body),
        F.lit("\r\n"),
    )
    linked.select(
        "page_id", F.encode(head, "UTF-8").alias("header"), "sha256", F.col("payload_bytes")
    ).write.parquet(f"{path}/headers")
    # Rows of one digest have the same payload, so any of them serves; each task sends one at most.
    rows.select("sha256", "payload_bytes", "payload").dropDuplicates(["sha256"]).write.parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The parsed header fields of every record, from the exact header bytes.

    record_id, record_type, target_uri, payload_digest (bare), refers_to, content_length, and the header.
    Missing lines give null.
    """
    head = F.decode("header", "UTF-8")
    field = lambda name, value="([^\\r\\n]*)": F.nullif(F.regexp_extract(head, f"\\n{name}: {value}\\r\\n", 1), F.lit(""))
    return spark.read.parquet(f"{path}/headers").select(
        field("WARC-Record-ID", "<urn:page:([^\\r\\n]*)>").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest", "sha1:([^\\r\\n]*)").alias("payload_digest"),
        field("WARC-Refers-To", "<urn:page:([^\\r\\n]*)>").alias("refers_to"),
        field("Content-Length").cast("bigint").alias("content_length"),
        "header",
        "sha256",
    )


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Digest and size of every stored payload, worked out from its bytes; a mismatch is an error."""
    bad = F.sha2("payload", 256) != F.col("sha256")
    return spark.read.parquet(f"{path}/payloads").select(
        F.when(bad, F.raise_error(F.lit("a stored payload does not match its digest"))).otherwise(F.col("sha256")).alias("sha256"),
        base32_of_hex(F.sha1("payload")).alias("stored_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )


def read_records(spark: SparkSession, path: str, resolve: bool = False) -> DataFrame:
    """The original records: header, payload (responses; with `resolve` revisits too) and record bytes."""
    heads = read_headers(spark, path)
    needs = F.lit(True) if resolve else F.col("record_type") == "response"
    stored = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    joined = heads.filter(needs).join(stored, "sha256", "left")
    if not resolve:
        joined = joined.unionByName(heads.filter(~needs).withColumn("payload", F.lit(None).cast("binary")))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("header", body, F.encode(F.lit(RECORD_END), "UTF-8")))
