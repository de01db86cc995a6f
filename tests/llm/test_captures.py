"""WARC archives and their index: round trips of odd pages, the index against a plain search."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from rollbook.llm import captures

SCHEMA = "page_id long, url string, html string"
ODD = [
    (1, "http://www.b.org/x?q=1", "same"), (2, "http://b.org/", "same"), (3, None, "same"), (4, "http://a.b.org:8080/ü", None), (5, "", ""), (6, "no url", " "),
    (7, "http://b.org/", "other"), (7, "http://b.org/", "other"), (8, "http://b.org/", "other"), (None, "http://c.org/", "lone"), (None, "http://c.org/", "same"),
    (9, "http://[broken/", "Ä" * 100_000), (10, "http://b.org/a\r\nb: c", "x\r\n\r\ny"), (11, "http://e.org:port/", "WARC/1.1"), (12, "https://B.ORG./", "lone2"),
]


def plain(rows, least=0):
    last = {}
    for p, _, html in rows:
        body = (html or "").encode()
        if p is not None and len(body) >= least:
            last[body] = max(last.get(body, p), p)
    out = []
    for p, _, html in rows:
        body = (html or "").encode()
        to = last.get(body)
        to = None if to == p else to
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 3, 256])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_of_odd_pages(spark, tmp_path, block, least):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "sha1", "payload", "file", "offset", "last", "refers_to")})
    found = captures.round_trip(df, captures.Archive(str(tmp_path / "a"), least, block))
    assert sorted(map(tuple, found.collect()), key=str) == plain(ODD, least)


def test_one_url_with_most_captures(spark, tmp_path):
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/p", f"page {i % 50}") for i in range(900)]
    found = captures.round_trip(spark.createDataFrame(rows, SCHEMA), captures.Archive(str(tmp_path / "a"), block=16))
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert captures.round_trip(spark.createDataFrame([], SCHEMA), captures.Archive(str(tmp_path / "a"))).count() == 0


def test_lookup_of_some_pages_and_unknown_ones(spark, tmp_path):
    rows = [(i, f"http://h{i % 40}.org/{i}", f"page {i}") for i in range(400)]
    archive = captures.Archive(str(tmp_path / "a"), block=8, file_bytes=4000)
    parts = captures.build_index(captures.write(spark.createDataFrame(rows, SCHEMA), archive), archive)
    assert len(os.listdir(tmp_path / "a" / "records")) > 8  # files end at their size
    wanted = spark.createDataFrame([(5, "http://h5.org/5"), (5, "http://h5.org/5"), (6, "http://nobody.org/"), (77, "http://h37.org/77"), (400, "http://h0.org/399")], "page_id long, url string")
    found = captures.read(wanted, parts, archive).collect()
    assert sorted((r["page_id"], r["url"], bytes(r["payload"])) for r in found) == [(5, "http://h5.org/5", b"page 5"), (77, "http://h37.org/77", b"page 77")]


def test_index_reads_few_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i:04d}.org/", "x") for i in range(2000)]
    archive = captures.Archive(str(tmp_path / "a"), block=10)
    parts = captures.build_index(captures.write(spark.createDataFrame(rows, SCHEMA), archive), archive)
    index = captures.Index(parts, archive)
    read = []
    whole = index._range
    index._range = lambda *a: read.append(a) or whole(*a)
    assert [x[1] for x in index.find(captures.url_key("http://h1234.org/"), "1234")] == ["1234"]
    assert len(read) == 2  # a directory and a block


def test_files_left_behind_are_not_read(spark, tmp_path):
    archive = captures.Archive(str(tmp_path / "a"))
    os.makedirs(tmp_path / "a" / "records")
    (tmp_path / "a" / "records" / "lost.warc.gz").write_bytes(b"half a rec")
    assert captures.round_trip(spark.createDataFrame(ODD, SCHEMA), archive).count() == len(ODD)


def test_records_are_standard():
    member = captures.record("1", "http://b.org/", b"<p>", hashlib.sha1(b"<p>").hexdigest(), None)
    text = gzip.decompress(member)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\n<p>\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        captures.parse(gzip.compress(text.replace(b"<p>", b"<q>")))


def test_keys():
    assert captures.url_key("http://WWW.a.org:80/b?c#d") == "org,a,www:80)/b?c"
    assert captures.url_key("http://a.org") == "org,a)/"
    assert captures.url_key(None) == "" and captures.url_key("x y") == "~x y"
