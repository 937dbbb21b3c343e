"""Content-addressed WARC archive.

Two tables in the shared folder make up an archive:

* ``payloads(digest, payload, ...)`` holds every distinct payload's bytes
  once, under its SHA-256;
* ``headers(page_id, digest, header)`` holds every record's exact header
  block, one row per record, without the payload.

A record is ``header + payload + CRLF CRLF`` (a revisit record has no
payload) and comes back from a join on the digest. The strong digest is
verified twice: rows that share a SHA-256 must share length and SHA-1 when the
archive is written, and every stored payload is hashed again when it is read;
a mismatch stops the job.

A page's copies (a third of all pages may be one payload) only meet as
(digest, page_id) pairs that are pre-aggregated before the shuffle; the bytes
of one copy are stored.

Defined cases: null html is an empty payload; a null url is written as an
empty target; line breaks in a url are percent-encoded; of exact repeated rows
(same page_id) all that carry the largest page_id are responses; a page with a
null page_id is a revisit where a copy has an id, else a response, and is
never referred to; empty tables give empty archives; extra columns are
ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, text_or_empty

CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Folders of one archive."""
    headers: str
    payloads: str


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _header(date: str) -> Column:
    """Exact WARC/1.1 header block of a record, blank line included."""
    target = F.replace(F.replace(text_or_empty("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_uri(F.col("page_id")), F.lit("<urn:page:>"))),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("refers_to").isNotNull(), F.lit(
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("refers_to"))),  # null: left out by concat_ws
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), body.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, min_revisit_bytes: int = 1000,
                  date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write one record per row of ``pages(page_id, url, html)``.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one
    with the largest page_id is the response, the others revisit it.
    """
    spark = pages.sparkSession
    root = scratch(spark, "warc")
    archive = Archive(f"{root}/headers", f"{root}/payloads")
    payload = F.encode(text_or_empty("html"), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "digest": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload")})
    groups = rows.groupBy("digest").agg(
        F.max("page_id").alias("newest"),
        # verified digest: one digest, one length, one second digest
        F.when((F.min("payload_bytes") != F.max("payload_bytes"))
               | (F.min(F.xxhash64("sha1")) != F.max(F.xxhash64("sha1"))),
               F.raise_error(F.lit("two payloads share a SHA-256 digest"))).alias("clash"))
    groups = groups.where("clash IS NULL").select("digest", "newest")
    marked = rows.select("page_id", "url", "payload_bytes", "digest", "sha1").join(groups, "digest").withColumn(
        "refers_to", F.when((F.col("payload_bytes") >= min_revisit_bytes)
                            & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")))
    marked.select("page_id", "digest", _header(date).alias("header")).write.option(
        "compression", "zstd").parquet(archive.headers)
    # Only the newest page's bytes cross the shuffle; its repeated rows fold there.
    null_id = F.lit(-(1 << 63))
    newest = groups.select("digest", F.coalesce("newest", null_id).alias("key"))
    one = rows.select("digest", F.coalesce("page_id", null_id).alias("key"), "payload").join(
        newest, ["digest", "key"], "left_semi").dropDuplicates(["digest", "key"])
    one.select("digest", "payload").write.option(
        "compression", "zstd").parquet(archive.payloads)
    return archive


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", f"(?md)^{name}: ?([^\r\n]*)\r$", 1), F.lit(""))


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Reconstruct every record: ``page_id``, ``header``, ``payload`` (of the
    record itself or of the response it revisits), ``record`` (the original
    record's bytes), and what the header and the verified payload say:
    ``record_type``, ``refers_to``, ``content_length``, ``header_digest``,
    ``payload_bytes``, ``payload_digest`` (SHA-1, hex).
    """
    stored = spark.read.schema("digest binary, payload binary").parquet(archive.payloads)
    stored = stored.withColumn("digest", F.when(
        F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")))
    # Facts of a payload are computed once per stored payload, before the join.
    stored = stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
                           F.sha1("payload").alias("payload_digest"))
    heads = spark.read.schema("page_id long, digest binary, header string").parquet(archive.headers)
    heads = heads.select(
        "page_id", "digest", "header", _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1).cast("long").alias("refers_to"),
        _field("Content-Length").cast("long").alias("content_length"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("header_digest"))
    both = heads.join(stored, "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select(
        "page_id", "header", "payload",
        F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"),
        "record_type", "refers_to", "content_length", "header_digest", "payload_bytes",
        F.when(F.col("payload_digest") == F.col("header_digest"), F.col("payload_digest")).otherwise(
            F.raise_error(F.lit("a record's header names another payload digest")).cast("string")
        ).alias("payload_digest"))
