from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from marisma.llm import warc as W
from marisma.session import work_dir


def sha(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages, min_bytes=0):
    out = []
    for page, _, text in pages:
        body = (text or "").encode()
        same = [p for p, _, t in pages if (t or "").encode() == body and p is not None]
        top = max(same) if same else None
        again = len(body) >= min_bytes and page != top
        out.append((page, len(body), sha(body), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/x y", "<p>é</p>\r\n\r\nx"), (2, None, None), (3, "http://b", ""), (4, "http://b", "same"), (5, "http://c\n", "same"), (6, "http://d", "same"),
    (7, "http://e", "line\nline\n\n"), (8, "u", "WARC/1.1\r\n\r\nfiledesc://x 1 2 3 4\n1 0 x\n"), (9, "u", "x" * 300_000), (10, "v", "\x00\x1f￿"), (11, "http://f", "HTTP/1.1 200\r\n\r\nin"),
]


def run(spark, pages, **kw):
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    return sorted((tuple(r) for r in W.archive_pages(df, **kw).collect()), key=str)


@pytest.mark.parametrize("least", [0, 3, 5])
def test_round_trip_equals_brute_force(spark, least):
    assert run(spark, PAGES, min_bytes=least) == brute(PAGES, least)


def test_many_copies_and_many_records(spark):
    pages = [(i, f"http://h/{i}", "copy" if i % 3 else f"own {i}") for i in range(3000)]
    assert run(spark, pages) == brute(pages)


def test_repeated_page_ids_and_nulls(spark):
    rows = run(spark, [(1, "a", "z"), (1, "a", "z"), (None, None, "z"), (None, None, "y")])
    assert [(r[0], r[3], r[4]) for r in rows].count((1, "response", None)) == 1
    assert [(r[0], r[3], r[4]) for r in rows].count((1, "revisit", 1)) == 1
    assert (None, "revisit", 1) in [(r[0], r[3], r[4]) for r in rows] and len(rows) == 4


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    block = b"HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\n\n"
    data = W.arc_version_block("f.arc", "19970101000000", version)
    data += W.arc_record("http://a b/c", "19970101", block, version, 0, "f.arc") + W.arc_record(None, "x", b"plain", version, 9, "f.arc")
    first, second = W.read_arc(data)
    assert first.fields["url"] == "http://a b/c" and first.block == block and first.payload == b"body\n\n" and first.http("x-page-id") == "5"
    assert data[first.offset :].startswith(b"http://a b/c") and second.fields["url"] == "-" and second.head == b"" and second.payload == b"plain"
    assert list(W.read_arc(gzip.compress(data[:-8]) and data[:-8]))[-1] is None  # the declared length is not there
    assert [r.block for r in W.read_arc(W.unpacked(gzip.compress(data[:100]) + gzip.compress(data[100:])))] == [block, b"plain"]
    assert W.timestamp("19970101") == "1997-01-01T00:00:00Z" and W.timestamp("x") == "1970-01-01T00:00:00Z"


def test_versions_may_alternate_in_one_file():
    parts = b"".join(W.arc_version_block("f", "1", v) + W.arc_record("u", "2", f"v{v}".encode(), v, 0, "f") for v in (1, 2, 1))
    assert [r.block for r in W.read_arc(parts)] == [b"v1", b"v2", b"v1"]


def test_bytes_of_the_files(spark):
    """What lies on disk is WARC: any reader of the format finds ids, types, digests and lengths."""
    pages = spark.createDataFrame([(1, "http://a", "one"), (2, "http://b", "one"), (3, "http://c", "été")], "page_id long, url string, html string").coalesce(1)
    old, new = work_dir(spark, "arc"), work_dir(spark, "warc")
    W.write_arc(pages, old)
    files = W.archives(spark, old)
    W.convert(files, W.revisits(W.arc_digests(files)), new)
    content = b"".join(W.unpacked(bytes(r.content)) for r in W.archives(spark, new).collect())
    assert content.endswith(b"\r\n\r\n")
    records = [(h, b) for h, b in W.read_warc(content)]
    kinds = sorted(h["warc-type"] for h, _ in records)
    assert kinds.count("response") == 2 and kinds.count("revisit") == 1 and "warcinfo" in kinds
    ids = [h["warc-record-id"] for h, _ in records]
    assert len(set(ids)) == len(ids) and all(i.startswith("<urn:uuid:") for i in ids)
    for h, block in records:
        if h["warc-type"] != "warcinfo":
            assert h["warc-block-digest"] == "sha1:" + sha(block) and h["warc-date"] == "2024-01-01T00:00:00Z"
        if h["warc-type"] == "revisit":
            assert h["warc-refers-to"] in ids and h["warc-refers-to-target-uri"] == "http://b" and block.endswith(b"\r\n\r\n")


def test_damaged_archives_are_counted(spark):
    path = work_dir(spark, "arc")
    good = W.arc_version_block("f", "1", 1) + W.arc_record("u", "2", b"ok", 1, 0, "f")
    spark.createDataFrame([(bytearray(good + b"broken line"),)], "b binary").select(F.col("b").cast("string")).write.text(path)
    rows = W.arc_digests(W.archives(spark, path).filter(F.length("content") > 0)).collect()
    assert sorted((r.damaged, r.length) for r in rows if r.length is not None) == [(0, 2)] and sum(r.damaged for r in rows) == 1


def test_urls_that_look_like_version_blocks(spark):
    pages = [(i, "filedesc://old.arc" if i % 7 == 3 else f"http://h/{i}", f"text {i}") for i in range(40)]
    assert run(spark, pages) == brute(pages)


def test_damaged_archives_stop_the_round_trip(spark, monkeypatch):
    write = W.write_arc
    broken = [(1, "u", W.arc_version_block("f", "1", 1).decode() + "broken line")]

    def damage(pages, path):
        write(pages, path)
        spark.createDataFrame(broken, "a int, b string, value string").select("value").coalesce(1).write.mode("append").text(path)

    monkeypatch.setattr(W, "write_arc", damage)
    with pytest.raises(ValueError, match="1 archives"):
        run(spark, PAGES)
