"""Content-addressed WARC archive.

``write_archive`` makes one WARC/1.1 record per page and stores it in two Parquet tables in the
shared folder: ``headers`` holds each record's exact header bytes, ``blobs`` each distinct payload
once, under its SHA-256. ``read_archive`` joins them back, tests every payload against its
content address and the digest and length that its header states, and ``record_bytes`` gives the
records as they'd stand in a .warc file.

Of records with equal payloads of ``min_bytes`` bytes or more, that with the largest key is the
``response``, the others are ``revisit`` records that refer to it. Smaller payloads are always
``response``.

Edge cases: null html is an empty payload; a null URL has no WARC-Target-URI; control characters
in URLs are percent-encoded, so that a header is never broken. Rows that repeat a key and payload
are records of their own (several responses if the key is the largest), their payload is stored
once. Null keys are written as ``null`` and compare equal. Only key, url and html are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_salted, shared_path, written

#: Fixed values of RFC 4648 and WARC/1.1.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive lie."""

    headers: str
    blobs: str


def base32_of_hex(digest: Column, n_hex: int = 40) -> Column:
    """Upper-case base32 of a hex string whose length is a multiple of ten digits (five bytes)."""
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in range(1, n_hex, 10)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _safe(url: Column) -> Column:
    for code in (13, 10, 9, 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _header(fields: list[tuple[str, Column | str]], first: str) -> Column:
    """Header block as text; a field whose value is null is left out."""
    lines = [F.lit(first + "\r\n")]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("\r\n"))


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> Archive:
    """Write one record per row; payload bytes go through one shuffle, by key, so copies don't pile up in a task."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    facts = rows.select(
        "id", "url", F.sha2("payload", 256).alias("address"), base32_of_hex(F.sha1("payload")).alias("digest"), F.length("payload").cast("bigint").alias("size")
    )
    # equal payloads meet as pre-aggregated digests only
    firsts = written(facts.groupBy("address").agg(F.max("id").alias("first_id"), F.count("*").alias("n")), "warc-firsts")

    archive = Archive(shared_path(spark, "warc-headers"), shared_path(spark, "warc-blobs"))
    # a struct is never null, even of a null key: payloads stay where the join put them when repeated rows go
    holders = firsts.select("address", F.struct(F.col("first_id").alias("id")).alias("_at"))
    (
        rows.select(F.sha2("payload", 256).alias("address"), F.struct("id").alias("_at"), "payload")
        .join(holders, ["address", "_at"])
        .dropDuplicates(["address", "_at"])
        .select("address", "payload")
        .write.option("compression", "zstd")
        .parquet(archive.blobs)
    )

    # records of a hot payload, such as an empty page's, are dealt over several tasks
    joined = join_salted(facts, firsts, ["address"], by=["id"])
    again = (F.col("size") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("size"))], "HTTP/1.1 200 OK")
    head = _header(
        [
            ("WARC-Type", F.when(again, "revisit").otherwise("response")),
            ("WARC-Record-ID", _urn(F.col("id"))),
            ("WARC-Target-URI", _safe(F.col("url"))),
            ("WARC-Date", EPOCH),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(again, _urn(F.col("first_id")))),
            ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", F.octet_length("http") + F.when(again, 0).otherwise(F.col("size"))),
        ],
        "WARC/1.1",
    )
    joined = joined.withColumn("http", http).withColumn("warc", head)
    joined.select("id", "address", F.encode("warc", "UTF-8").alias("warc_header"), F.encode("http", "UTF-8").alias("http_header")).write.option(
        "compression", "zstd"
    ).parquet(archive.headers)
    return archive


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("_head", rf"(?m)^{name}: ([^\r\n]*)$", 1), F.lit(""))


def read_archive(spark, archive: Archive) -> DataFrame:
    """(id, warc_header, http_header, payload, record_type, refers_to, digest) of every record, payloads joined back and tested."""
    blobs = spark.read.parquet(archive.blobs)
    # each stored payload is digested once, where it is read
    blobs = blobs.select("address", "payload", F.sha2("payload", 256).alias("_found"), base32_of_hex(F.sha1("payload")).alias("digest"))
    headers = spark.read.parquet(archive.headers)
    counts = headers.groupBy("address").agg(F.count("*").alias("n"))
    rows = join_salted(headers, blobs, ["address"], how="left", by=["id"], counts=counts).withColumn("_head", F.decode("warc_header", "UTF-8"))
    record_type, size = _field("WARC-Type"), F.length("payload")
    stated = F.octet_length("http_header") + F.when(record_type == "revisit", 0).otherwise(size)
    sound = (
        (F.col("_found") == F.col("address"))
        & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("digest")))
        & (_field("Content-Length").cast("bigint") == stated)
    )
    return rows.select(
        "id",
        "warc_header",
        "http_header",
        F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(F.raise_error("WARC record fails its digest or length")).alias("payload"),
        record_type.alias("record_type"),
        F.nullif(F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1), F.lit("null")).alias("refers_to"),
        "digest",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """(id, record): the exact bytes of each record in a .warc file (a revisit has no payload in its block)."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("id", F.concat("warc_header", "http_header", body, F.lit(b"\r\n\r\n")).alias("record"))


def archived_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archive, read it back, and give (key, payload_bytes, payload_digest, record_type, refers_to)."""
    archive = write_archive(pages, key, url, html, min_bytes)
    return read_archive(pages.sparkSession, archive).select(
        F.col("id").alias(key),
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(pages.schema[key].dataType).alias("refers_to"),
    )


def _base32_sql(digest: str) -> str:
    """DuckDB text of a 40-digit hex string in base32, five bits at a time."""
    parts = []
    for at in range(1, 40, 10):
        value = f"('0x' || substr({digest}, {at}, 10))::BIGINT"
        parts += [f"substr('{BASE32}', (({value} >> {shift}) & 31)::INTEGER + 1, 1)" for shift in range(35, -1, -5)]
    return " || ".join(parts)


ARCHIVED_PAGES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id, sha1(coalesce(html, '')) AS hex FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_base32_sql("hex")} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p"""
