"""The archive as a round trip."""

import base64
import hashlib

import pytest

from shopspark.llm import warc
from shopspark.storage import scratch_path

PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 3),
         (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 3), (None, "u", "n"), (6, "http://f", "long " * 50_000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(i, u, h, "t", "h") for i, u, h in PAGES], "page_id long, url string, html string, record_type string, header string")


def test_report(pages):
    rows = warc.page_records(pages).collect()
    assert len(rows) == len(PAGES)
    facts = {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in PAGES}
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in rows} == facts
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=str)
    assert kinds == sorted(
        [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (5, "revisit", 5),
         (None, "response", None), (6, "response", None)], key=str
    )


def test_small_payloads_can_be_left_alone(pages):
    rows = warc.page_records(pages, revisit_bytes=9).collect()
    assert {r.page_id: r.record_type for r in rows if r.page_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "response")


def test_payloads_are_stored_once_and_files_read_back(spark, pages):
    path, files = scratch_path(spark, "a"), scratch_path(spark, "b")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    records = warc.read_archive(spark, path)
    warc.write_warc_files(records, files)
    back = warc.read_warc_files(spark, files).collect()
    assert len(back) == len(PAGES)
    whole = sorted(bytes(r.payload) for r in back if r.record_type == "response")
    assert whole == sorted({(h or "").encode() for _, _, h in PAGES})
    ids = {r.record_id for r in back}
    assert len(ids) == len(PAGES) and all(r.refers_to in ids for r in back if r.record_type == "revisit")


def test_a_changed_payload_is_noticed(spark, pages):
    path = scratch_path(spark, "c")
    warc.write_archive(pages, path)
    from pyspark.sql import functions as F

    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "utf-8")).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, f"{path}2").collect()


def test_empty_table(pages):
    assert warc.page_records(pages.limit(0)).collect() == []
