import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from markspark.llm import warc
from markspark.storage import new_path

SCHEMA = "page_id LONG, url STRING, html STRING, type STRING, record_id STRING, _bytes LONG"
SAME = "<html>" + "same page " * 30 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, "http://a.com/x?q=1#f", SAME), (2, "http://b.com", SAME), (3, None, SAME),
    (4, "http://c.com/\r\nWARC/1.1", "short"), (5, "http://c.com/", "short"), (6, "no url", None),
    (7, "http://d.com/", ""), (8, "http://é.com/ä b", "é☃🎉" * 40 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"),
    (9, "http://e.com/", "x" * 300_000), (10, "u", "\n\r\n"), (None, "http://f.com/", SAME),
    (12, "http://g.com/", "once only " * 20), (13, "http://h.com/", "twice " * 30), (13, "http://h.com/", "twice " * 30),
]


@pytest.fixture(scope="module")
def captures(spark):
    path = new_path(spark, "warc")
    warc.write_warc(warc.warc_records(pages(spark, ROWS)), path)
    return warc.assemble_captures(warc.read_warc(spark, path)).collect(), path


def fields(capture):
    for line in bytes(capture.metadata.content).decode().split("\r\n"):
        if line.startswith("page_id: "):
            return int(line[9:])
    return None


def test_one_nested_row_per_page(captures):
    rows, _ = captures
    assert sorted((fields(r) for r in rows), key=repr) == sorted((r[0] for r in ROWS), key=repr)
    for r in rows:
        assert r.request.type == "request" and r.metadata.type == "metadata"
        assert r.main.http_status == "HTTP/1.1 200 OK"


def test_payloads_come_back(captures):
    rows, _ = captures
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in rows:
        want = html[fields(r)]
        assert r.main.payload_digest == "sha256:" + hashlib.sha256(want).hexdigest()
        assert r.main.payload_length == len(want)
        assert bytes(r.main.content) == (want if r.main.type == "response" else b"")


def test_equal_payloads_revisit_the_smallest_id(captures):
    kinds = {}
    for r in captures[0]:
        kinds.setdefault(fields(r), []).append(r.main.type)
    assert kinds[1] == ["response"] and kinds[2] == kinds[3] == kinds[None] == ["revisit"]
    assert kinds[4] == kinds[5] == kinds[6] == kinds[7] == ["response"]
    assert kinds[13] == ["response", "response"]


def test_archives_are_warc(spark, captures):
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(captures[1])
    for row in names.collect():
        content = gzip.decompress(row.content)
        at = 0
        while at < len(content):
            assert content.startswith(b"WARC/1.1\r\n", at)
            head, _, _ = content[at:].partition(b"\r\n\r\n")
            length = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
            at += len(head) + 4 + length
            assert content[at : at + 4] == b"\r\n\r\n"
            at += 4


def test_revisits_find_their_page(spark):
    rows = [(1, "d", "response"), (2, "d", "revisit"), (3, "e", "response"), (None, "d", "revisit"),
            (5, "gone", "revisit"), (0, "d", "response")]
    df = spark.createDataFrame(rows, "page_id LONG, payload_digest STRING, record_type STRING")
    got = {(r.page_id, r.refers_to) for r in warc.revisits_by_digest(df).collect()}
    assert got == {(1, None), (0, None), (3, None), (2, 0), (None, 0), (5, None)}


def test_records_in_any_order_and_number(spark):
    rows = [("m1", "response", None), ("q1", "request", "m1"), ("q0", "request", "m1"),
            ("x", "metadata", "nowhere"), ("m2", "revisit", None), (None, "response", None),
            ("w", "warcinfo", None), ("d", "metadata", "m2")]
    df = spark.createDataFrame(rows, "record_id STRING, type STRING, concurrent_to STRING")
    got = {r.record_id: r for r in warc.assemble_captures(df).collect()}
    assert set(got) == {"m1", "m2"}
    assert got["m1"].request.record_id == "q0" and got["m1"].metadata is None
    assert got["m2"].request is None and got["m2"].metadata.record_id == "d"


def test_broken_archives_are_errors():
    whole = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r["block"] for r in warc.parse_warc(whole + gzip.decompress(gzip.compress(whole)))] == [b"abc"] * 2
    assert [r["block"] for r in warc.parse_warc(gzip.compress(whole) * 2)] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_warc(whole[:-6]))
    with pytest.raises(ValueError):
        list(warc.parse_warc(whole[:30]))


def test_empty(spark):
    path = new_path(spark, "warc")
    warc.write_warc(warc.warc_records(pages(spark, ROWS).limit(0)), path)
    assert warc.assemble_captures(warc.read_warc(spark, path)).count() == 0


def test_long_group_keeps_one_response(spark):
    df = spark.range(900).select(
        F.col("id").alias("page_id"), F.lit("http://a.com/").alias("url"),
        F.expr("IF(id % 3 = 0, repeat('same ', 40), concat(repeat('own ', 40), id))").alias("html"),
    )
    marked = warc.mark_revisits(df, "page_id", "html")
    assert marked.count() == 900 and marked.filter("_first = 0").count() == 300
