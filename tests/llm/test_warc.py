import hashlib

import pandas as pd
import pytest

from courtside.llm import warc
from courtside.llm.queries import ORACLE

from .conftest import rows_of

SCHEMA = "page_id long, url string, html string, digest string, payload string"
BIG = "<p>é" * 400
ROWS = [(1, "http://a/", BIG, "x", "y"), (2, "http://b/", BIG, "x", "y"), (9, None, BIG, "x", "y"), (3, "u", "small", "", ""),
        (4, "u\r\nWARC-Type: revisit", "small", "", ""), (5, "u", None, "", ""), (6, "u", "", "", ""),
        (7, "v WARC-Type: revisit\n", BIG + "!", "", ""), (8, "long", "z" * 300_000, "", ""), (9, None, BIG, "x", "y")]


def digest(out):
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_same_as_sql(llm_spark, oracle, rows):
    archive = warc.write_archive(llm_spark.createDataFrame(rows, SCHEMA))
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html", "digest", "payload"]).astype(
        {"page_id": "int64", "html": "string"})
    assert rows_of(digest(warc.read_archive(llm_spark, archive))) == oracle(ORACLE["op3_warc_archive"], pages=pages)


def test_records_come_back_exact(llm_spark):
    archive = warc.write_archive(llm_spark.createDataFrame(ROWS, SCHEMA))
    out = warc.read_archive(llm_spark, archive).collect()
    assert len(out) == len(ROWS)
    for r in out:
        html = next((h or "") for i, _, h, *_ in ROWS if i == r.page_id).encode()
        assert bytes(r.payload) == html and r.payload_digest == hashlib.sha1(html).hexdigest()
        body = html if r.record_type == "response" else b""
        assert bytes(r.record) == r.header.encode() + body + b"\r\n\r\n"
        assert r.header.endswith("\r\n\r\n") and r.header.startswith("WARC/1.1\r\nWARC-Type: " + r.record_type)
        assert r.content_length == len(body)
    by = {r.page_id: r for r in out}
    assert by[1].refers_to == by[2].refers_to == 9 and by[9].record_type == "response"
    assert by[4].record_type == "response" and "u%0D%0AWARC-Type: revisit" in by[4].header
    stored = llm_spark.read.parquet(archive.payloads)
    assert stored.count() == len({(h or "") for _, _, h, *_ in ROWS})  # every payload once


def test_null_page_ids(llm_spark):
    rows = [(None, "a", BIG, "", ""), (4, "b", BIG, "", ""), (None, "c", "only nulls " * 200, "", ""),
            (None, "d", "only nulls " * 200, "", "")]
    out = warc.read_archive(llm_spark, warc.write_archive(llm_spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in out) == [
        (0, "response", 0), (0, "response", 0), (0, "revisit", 4), (4, "response", 0)]


def test_a_changed_payload_is_noticed(llm_spark):
    archive = warc.write_archive(llm_spark.createDataFrame(ROWS, SCHEMA))
    from pyspark.sql import functions as F
    spoilt = warc.Archive(archive.headers, archive.payloads + "-spoilt")
    llm_spark.read.parquet(archive.payloads).withColumn(
        "payload", F.concat("payload", F.lit(b"x"))).write.parquet(spoilt.payloads)
    with pytest.raises(Exception, match="does not match its digest"):
        digest(warc.read_archive(llm_spark, spoilt)).collect()
