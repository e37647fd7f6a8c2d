"""Web archives: exact round trip, assembly through concurrent-to, odd rows."""

import base64
import gzip
import hashlib
import io

from trialstats.llm.warc import archive_round_trip, assemble, captures, parse_records, read_archive, write_archive

ODD = "page_id long, url string, html string, n int"


def _want(rows, least=0):
    rows = [(r[0], (r[2] or "").encode()) for r in rows]
    last = {}
    for i, b in rows:
        if i is not None and len(b) >= least:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, b in rows:
        keep = len(b) < least or b not in last or i == last[b]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if keep else "revisit", None if keep else last[b]))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert _rows(archive_round_trip(spark, pages)) == _want([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def test_odd_rows(spark):
    rows = [(1, "http://a/x?y#z", "same\r\n\r\nWARC/1.1\r\n", 0), (2, None, "same\r\n\r\nWARC/1.1\r\n", 1), (3, "bad\r\nurl", None, 2), (4, "", "", 3),
            (5, "http://b", "é" * 70_000, 4), (5, "http://b", "é" * 70_000, 4), (None, "http://c", "none", 5), (None, "http://c", "", 6), (6, "http://d", "once", 7)]
    df = spark.createDataFrame(rows, ODD)
    assert _rows(archive_round_trip(spark, df)) == _want(rows)
    assert _rows(archive_round_trip(spark, df, min_revisit_bytes=1)) == _want(rows, 1)
    assert archive_round_trip(spark, spark.createDataFrame([], ODD)).collect() == []


def test_captures_are_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.example/p?q=1", "<p>x</p>", 0), (2, "http://a.example/", "<p>x</p>", 0)], ODD)
    path = str(tmp_path / "warc")
    write_archive(df, path)
    got = {r["page_id"]: r for r in captures(spark, path, payloads=True).collect()}
    assert got[2]["response"]["warc_type"] == "response" and bytes(got[2]["response"]["payload"]) == b"<p>x</p>"
    assert got[1]["response"]["warc_type"] == "revisit" and got[1]["response"]["refers_to"] == got[2]["hub"] and got[1]["response"]["http_bytes"] == 8
    assert got[1]["request"]["http_status"].startswith("GET /p?q=1 HTTP/1.1") and got[1]["request"]["url"] == "http://a.example/p?q=1"
    assert got[2]["response"]["declared_digest"] == got[2]["response"]["payload_digest"]
    kinds = read_archive(spark, path).groupBy("warc_type").count().collect()
    assert {r["warc_type"]: r["count"] for r in kinds} == {"response": 1, "revisit": 1, "request": 2, "metadata": 2}


def test_side_records_may_be_missing_or_many(spark):
    rows = [("response", "h1", None), ("request", "r2", "h1"), ("request", "r1", "h1"), ("response", "h2", None), ("metadata", "m", "gone"), (None, None, None)]
    got = {r["hub"]: r for r in assemble(spark.createDataFrame(rows, "warc_type string, record_id string, concurrent_to string")).collect()}
    assert got["h1"]["request"]["record_id"] == "r1" and got["h1"]["metadata"] is None and got["h2"]["request"] is None and len(got) == 2


def test_parser_reads_members_and_plain_files():
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r[9] for r in parse_records(io.BytesIO(record * 2))] == ["hello", "hello"]
    packed = gzip.compress(record) + gzip.compress(record)
    assert len(list(parse_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(packed)))))) == 2
