"""WARC round trips, segment checks, chunked framing."""

import base64
import collections
import hashlib

from pyspark.sql import functions as F

from calibspark.llm import warc
from calibspark.llm.scratch import scratch_folder
from tests.conftest import SF_MID


def test_chunked_framing_round_trip_and_faults():
    for data in (b"", b"x", b"ab" * 5000, b"0\r\n\r\n"):
        assert warc.unchunk(warc.chunked(data, 7)) == data
    assert warc.unchunk(b"5;ext=1\r\nhello\r\n0\r\n\r\n") == b"hello"
    for broken in (b"", b"zz\r\nhello\r\n0\r\n\r\n", b"9\r\nhello\r\n0\r\n\r\n", b"5\r\nhello\r\n"):
        assert warc.unchunk(broken) is None


def expected(pages):
    groups = collections.defaultdict(list)
    for i, h in pages:
        groups[h or ""].append(i)
    out = {}
    for i, h in pages:
        data, top = (h or "").encode(), max(groups[h or ""])
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                  "response" if i == top else "revisit", None if i == top else top)
    return out


def test_query_against_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/pages.parquet").select("page_id", "html").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op1_warc_segments(spark, SF_MID).collect()}
    assert got == expected(pages)


def round_trip(spark, rows, **sizes):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_folder(spark, "test-archives")
    manifest = warc.write_archives(pages, folder, **sizes)
    return warc.read_records(spark, folder, manifest)


def test_copies_revisit_the_largest_id(spark):
    rows = [(i, f"u{i}", "same" if i % 2 else f"own {i}") for i in range(12)] + [(20, None, None), (21, "u", "")]
    out = warc.resolve_revisits(warc.decode_payloads(warc.reassemble(round_trip(spark, rows)), with_payload=False)).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out} == expected([(r[0], r[2]) for r in rows])


def test_payloads_come_back_whole_over_many_segments_and_files(spark):
    rows = [(i, f"http://x/{i}", "é%d " % i * n) for i, n in enumerate((0, 1, 50, 700, 9000))]
    records = round_trip(spark, rows, segment_bytes=256, chunk_bytes=100, file_bytes=4096)
    assert records.where("record_type = 'continuation'").count() > 50
    out = {r.page_id: r for r in warc.decode_payloads(warc.reassemble(records)).collect()}
    assert all(out[i].complete and bytes(out[i].payload) == html.encode() for i, _, html in rows)


def test_missing_repeated_and_altered_segments(spark):
    rows = [(1, "u", "abc" * 500)]
    records = round_trip(spark, rows, segment_bytes=256, chunk_bytes=100).cache()
    assert warc.reassemble(records.union(records)).select("complete").collect() == [(True,)]  # repeated rows
    for broken in (records.where("segment_number IS DISTINCT FROM 3"), records.where("segment_number IS DISTINCT FROM 1"),
                   records.where("total_length IS NULL"),
                   records.union(records.where("segment_number = 2").withColumn("block", F.lit(b"other")))):
        got = warc.decode_payloads(warc.reassemble(broken)).collect()
        assert [(r.complete, r.payload) for r in got] == [(False, None)]


def test_plain_and_truncated_archives():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    got = list(warc.parse_archive(record + record))
    assert [(r["record_id"], r["block"]) for r in got] == [("urn:a", b"hello")] * 2
    assert list(warc.parse_archive(record[:-6]))[0]["block"] == b"hel"
    assert list(warc.parse_archive(b"")) == []
