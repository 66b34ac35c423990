import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from spindrift.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def archive(spark, rows, **options):
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("address", "payload", "digest", "size", "_tie", "record_type")})
    path = common.scratch(spark, "w")
    warc.write(d, path, **options)
    return path, warc.read(spark, path)


def test_records_against_brute_force(spark):
    rows = [(1, "http://a/1", "<p>x"), (2, None, "<p>x"), (3, "http://a/3", None), (4, "u\r\nX: y", ""), (5, "http://b", "é日本" * 1000), (6, "http://c", "<p>x"), (7, "http://d", "z" * 300_000), (9, "http://e", "é日本" * 1000)]
    path, read = archive(spark, rows)
    got = {r.page_id: r for r in read.collect()}
    lead = {}
    for p, _, h in rows:
        lead[h or ""] = max(p, lead.get(h or "", p))
    assert len(got) == len(rows)
    for p, _, h in rows:
        b = (h or "").encode()
        r = got[p]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert bytes(r.payload) == b and r.verified
        assert (r.record_type, r.refers_to) == (("response", None) if lead[h or ""] == p else ("revisit", lead[h or ""]))
    assert spark.read.parquet(f"{path}/payloads").count() == len(lead)
    records = {r.page_id: bytes(r.record) for r in warc.records(read).collect()}
    assert records[6].endswith(b"\r\n\r\n<p>x\r\n\r\n") and b"WARC-Type: response" in records[6]
    assert records[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and b"WARC-Refers-To: <urn:page:6>" in records[1]
    assert b"\r\nX: y" not in records[4]


def test_smaller_payloads_can_all_be_responses(spark):
    _, read = archive(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "long" * 9), (4, "d", "long" * 9)], min_revisit_bytes=10)
    assert sorted((r.page_id, r.record_type) for r in read.collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_repeated_rows_and_null_ids(spark):
    _, read = archive(spark, [(1, "a", "x"), (1, "a", "x"), (None, "n", "x"), (None, "n", "y")])
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in read.collect())
    assert got == [("1", "response", "None"), ("1", "revisit", "1"), ("None", "response", "None"), ("None", "revisit", "1")]
    _, read = archive(spark, [(None, "a", "x"), (None, "b", "x")])
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in read.collect()) == [(None, "response", None), (None, "revisit", None)]


def test_damaged_payloads_are_errors(spark):
    path, read = archive(spark, [(1, "a", "x" * 50), (2, "b", "y")])
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.octet_length("payload") > 1, F.lit("z").cast("binary")).otherwise(F.col("payload")))
    bad.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, f"{path}-bad").select("page_id").collect()
    assert sorted((r.page_id, r.verified) for r in warc.read(spark, f"{path}-bad", strict=False).collect()) == [(1, False), (2, True)]
    assert read.count() == 2


def test_empty(spark):
    assert archive(spark, [])[1].count() == 0
