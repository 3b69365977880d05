"""Legacy ARC archives to WARC, and WARC read back.

ARC files hold version blocks (`filedesc://`) and records.  A record is one header line, whose
fields depend on the version, and as many bytes as its last field declares:

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The line is split from its right end, so blanks in a URL do no harm.  The converter makes a WARC
record of each: an identifier (a name-based UUID of file and offset), an ISO timestamp, a type and
Content-Type, and SHA-1 digests of block and payload.  Records of equal payload become revisits of
one of them.

Archives are read and written by Spark only, so they may lie wherever Spark can go.  A record is
written as one row of text without its last line feed, which the writer puts back, so the files hold
the exact bytes.  Payloads never move through a shuffle unless the revisits outgrow a broadcast:
what is compared is a table of digests.

Defined cases: null html is an empty payload and a null URL is `-`; an empty payload is a payload;
records with one page_id are told apart by file and offset; a header that cannot be read ends its
file, and is counted in `damaged`, which stops `archive_pages`; other columns are ignored; empty tables make empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.session import cut_lineage, work_dir

FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"],
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CHUNK_BYTES = 4_000_000
_HTTP_END = re.compile(rb"\r?\n\r?\n")


@dataclass
class Record:
    """One archived response: where it stood, its header fields, and its bytes."""

    offset: int
    fields: dict[str, str]
    block: bytes

    @property
    def head(self) -> bytes:
        """HTTP status line and headers, with their blank line; empty if the block has none."""
        m = _HTTP_END.search(self.block) if self.block.startswith(b"HTTP/") else None
        return self.block[: m.end()] if m else b""

    @property
    def payload(self) -> bytes:
        return self.block[len(self.head) :]

    def http(self, name: str) -> str | None:
        m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", self.head)
        return m[1].decode("utf-8", "replace") if m else None


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def unpacked(content: bytes) -> bytes:
    """Plain, or one or more gzip members."""
    out = []
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(content))
        content = z.unused_data
    return b"".join(out) if out else content


# ---------------------------------------------------------------- ARC

def arc_version_block(name: str, date: str, version: int) -> bytes:
    body = f"{version} 0 archive\n{TITLES[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain ".encode() + (b"" if version == 1 else b"200 - - 0 " + name.encode() + b" ") + f"{len(body)}\n".encode() + body + b"\n"


def arc_record(url: str | None, date: str, block: bytes, version: int, offset: int, name: str) -> bytes:
    head = f"{re.sub(r'[\r\n]', '', url or '') or '-'} 0.0.0.0 {date} text/html"
    if version == 2:
        head += f" 200 {sha1(block)} - {offset} {name}"
    return f"{head} {len(block)}\n".encode() + block + b"\n"


def read_arc(content: bytes) -> Iterator[Record | None]:
    """Records in order; None where the rest cannot be read."""
    at, version, first = 0, 1, True
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        start = end + 1 if end >= 0 else len(content)
        opens = line.startswith("filedesc://")
        if opens:
            second = content[start : content.find(b"\n", start)].split()
            if second and second[0] in (b"1", b"2"):
                version = int(second[0])
            elif first:
                yield None
                return
            else:
                opens = False  # a record whose URL looks like a version block
        first = False
        names = FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) < len(names) or not values[-1].isdigit() or start + int(values[-1]) > len(content):
            yield None
            return
        length = int(values[-1])
        if not opens:
            yield Record(at, dict(zip(names, values, strict=True)), content[start : start + length])
        at = start + length


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """pages (page_id, url, html) as gzipped ARC files; chunks of a file alternate between the versions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, count = [], 0, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(chunk)[:-1]], pa.binary())], names=["chunk"])

        for batch in batches:
            for page, url, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                version, name = 1 + count % 2, f"legacy-{count}.arc"
                if not chunk:
                    chunk.append(arc_version_block(name, date, version))
                body = (text or "").encode()
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode() + body
                chunk.append(arc_record(url, date, block, version, size, name))
                size += len(chunk[-1])
                if size >= CHUNK_BYTES:
                    yield done()
                    chunk, size, count = [], 0, count + 1
        if chunk:
            yield done()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _save(rows.mapInArrow(run, "chunk binary"), "chunk", path, 8)


def _save(rows: DataFrame, column: str, path: str, per_file: int) -> None:
    (
        rows.select(F.col(column).cast("string").alias("value")).write
        .option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)
    )


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def timestamp(date: str) -> str:
    """14 digits, or fewer, to ISO; what is missing is the earliest."""
    date = date if date.isdigit() and len(date) >= 4 else "1970"
    full = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(file: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}"


DIGESTS = "file string, offset long, page_id long, uri string, date string, length long, digest string, record_id string, damaged int"


def arc_digests(files: DataFrame) -> DataFrame:
    """One row per ARC record: where it is, and length and digest of its payload; damaged files add a row without digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for r in read_arc(unpacked(content.as_py())):
                    if r is None:
                        rows.append((file, -1, None, None, None, None, None, None, 1))
                        continue
                    page, body = r.http("X-Page-Id"), r.payload
                    rows.append((file, r.offset, int(page) if page else None, r.fields["url"], timestamp(r.fields["date"]), len(body), sha1(body), record_id(file, r.offset), 0))
                yield _table(rows, _DIGEST_TYPES, ["file", "offset", "page_id", "uri", "date", "length", "digest", "record_id", "damaged"])

    return files.mapInArrow(run, DIGESTS)


_DIGEST_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())


def _table(rows, types, names):
    columns = zip(*rows, strict=True) if rows else ([] for _ in types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def revisits(digests: DataFrame, min_bytes: int = 0) -> DataFrame:
    """file, offset of records that repeat a payload of at least min_bytes, and what they refer to: the largest page_id."""
    real = digests.filter("damaged = 0")
    first = (
        real.filter(F.col("length") >= min_bytes).groupBy("digest", "length")
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "file", "offset", "record_id", "uri", "date")).alias("to")).filter("n > 1")
    )
    return (
        real.join(first, ["digest", "length"]).filter("NOT (file = to.file AND offset = to.offset)")
        .select("file", "offset", F.col("to.record_id").alias("to_id"), F.col("to.uri").alias("to_uri"), F.col("to.date").alias("to_date"))
    )


def warc_record(r: Record, file: str, to: dict | None) -> bytes:
    """A response, resource or revisit record."""
    head, body = r.head, r.payload
    block = head if to else r.block
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if to else 'response' if head else 'resource'}",
        f"WARC-Record-ID: <{record_id(file, r.offset)}>", f"WARC-Date: {timestamp(r.fields['date'])}",
        f"WARC-Target-URI: {r.fields['url']}", f"WARC-IP-Address: {r.fields['ip']}",
        f"WARC-Payload-Digest: sha1:{sha1(body)}", f"WARC-Block-Digest: sha1:{sha1(block)}",
        f"Content-Type: {'application/http; msgtype=response' if head else r.fields['mime']}",
    ]
    if to:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{to['id']}>", f"WARC-Refers-To-Target-URI: {to['uri']}", f"WARC-Refers-To-Date: {to['date']}",
        ]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    body = b"software: marisma\r\nformat: WARC File Format 1.1\r\n"
    return (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{record_id(name, -1)}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    ).encode() + body + b"\r\n\r\n"


def convert(files: DataFrame, again: DataFrame, path: str) -> None:
    """ARC files to WARC files below path; again: revisits()."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                yield from _in_parts((file, r) for r in read_arc(unpacked(content.as_py())) if r is not None)

    def _in_parts(records):
        rows, size = [], 0
        for file, r in records:
            rows.append((file, r.offset, [r.fields[k] for k in ("url", "ip", "date", "mime")], r.block))
            size += len(r.block)
            if size >= CHUNK_BYTES:
                yield _table(rows, kinds, names)
                rows, size = [], 0
        if rows:
            yield _table(rows, kinds, names)

    kinds, names = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary()), ["file", "offset", "fields", "block"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = True
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("file", "offset", "fields", "to_id", "to_uri", "to_date")]
            made = []
            for (file, offset, f, to_id, to_uri, to_date), block in zip(zip(*cols, strict=True), batch.column("block"), strict=True):
                if new:
                    made.append(warc_info(f"{file}#{offset}")[:-1])
                    new = False
                r = Record(offset, dict(zip(("url", "ip", "date", "mime"), f, strict=True)), block.as_py())
                made.append(warc_record(r, file, {"id": to_id, "uri": to_uri, "date": to_date} if to_id else None)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    records = files.mapInArrow(parse, "file string, offset long, fields array<string>, block binary").join(again, ["file", "offset"], "left")
    _save(records.mapInArrow(build, "record binary"), "record", path, 20_000)


# ---------------------------------------------------------------- WARC

def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case names) and block of each record."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC header at byte {at}")
        fields = {}
        for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, content[start:stop]
        at = stop + 4


def read_back(files: DataFrame) -> DataFrame:
    """record_id, page_id, payload_bytes, payload_digest, record_type, refers_to_id of every record but the warcinfo ones.

    The digest of a record that has its payload is computed anew; one that differs from its header fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in read_warc(unpacked(content.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    r = Record(0, {}, block)
                    page, told = r.http("X-Page-Id"), fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "revisit":
                        size, digest = int(r.http("Content-Length") or 0), told
                    else:
                        size, digest = len(r.payload), sha1(r.payload)
                    if digest != told:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                    rows.append((
                        fields["warc-record-id"].strip("<>"), int(page) if page else None, size, digest,
                        kind, fields["warc-refers-to"].strip("<>") if kind == "revisit" else None,
                    ))
                yield _table(rows, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()),
                             ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"])

    return files.mapInArrow(run, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id): pages by way of ARC, converted to WARC, and read back."""
    spark = pages.sparkSession
    old, new = work_dir(spark, "arc"), work_dir(spark, "warc")
    write_arc(pages, old)
    files = archives(spark, old)
    digests = cut_lineage(arc_digests(files), "digests")
    damaged = digests.filter("damaged > 0").count()
    if damaged:
        raise ValueError(f"{damaged} archives cannot be read to their end")
    convert(files, cut_lineage(revisits(digests, min_bytes), "revisits"), new)
    records = cut_lineage(read_back(archives(spark, new)), "records")
    targets = records.filter("record_type != 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(targets, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
