"""Converter from the legacy ARC archive format to WARC.

An ARC file begins with a version block: a header line for the file itself, then
the version number and the names of the header fields.  Version 1 headers
have five fields, version 2 ten; every record is a header line of space-separated
fields and as many bytes as its last field declares.  The converter reads the
lines by the field names of the version block that governs them and
synthesises for each record what WARC asks for: a record id (a UUID from the
record's content), an ISO timestamp from the 14 or 12 digits, the type
(version block: warcinfo; HTTP message: response; else resource), and
SHA-256 digests of block and payload.  A response whose payload of at least
``REVISIT_BYTES`` equals that of a response with a smaller source key becomes a
revisit record: HTTP header only, with a reference to that response.

Archives are gzip files of about ``ARCHIVE_BYTES`` before compression, written and
read by Spark's own file sources, one file a row.  Which response a payload's
group refers to is found by a combining minimum per digest over (digest, key)
rows; payloads are never shuffled by digest.

Defined results: a null html is an empty payload; a null url is written as ``-``;
white space and control characters in urls are percent-encoded; records with a
null key are responses that nothing refers to; rows that repeat the smallest
key of a group are all responses.  Lines that are no header are skipped up to
the next line; a record cut short by the end of its file gets
``WARC-Truncated: length`` and what is there.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, spread_join

ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 100
# Fixed values of the two formats.
FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
          2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location",
              "Offset", "Filename", "Archive-length"]}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = "X-Source-Key"
_BAD = re.compile(rb"[\x00-\x20\x7f]")


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes
    truncated: bool

    @property
    def url(self) -> str:
        return self.fields["URL"]


def url_field(url: str | None) -> bytes:
    return _BAD.sub(lambda m: b"%%%02X" % m[0][0], (url or "-").encode("utf-8", "replace"))


def arc_header(version: int, url: bytes, date: str, mime: str, length: int, ip: str = "0.0.0.0", result: int = 200,
               checksum: str = "-", offset: int = 0, filename: str = "-") -> bytes:
    mid = [] if version == 1 else [str(result), checksum, "-", str(offset), filename]
    return b" ".join([url, *(x.encode() for x in (ip, date, mime, *mid, str(length)))]) + b"\n"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 glossa\n{' '.join(FIELDS[version])}\n".encode()
    return arc_header(version, b"filedesc://" + url_field(name), date, "text/plain", len(body), filename=name) + body


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    version, names, at = 1, FIELDS[1], 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].rstrip(b"\r")
        if line.startswith(b"filedesc://"):
            # the version block's own header has the fields of the version it declares
            second = data[end + 1:data.find(b"\n", end + 1)].split()
            version = int(second[0]) if second and second[0].isdigit() and int(second[0]) in FIELDS else 1
            names = FIELDS[version]
        cells = line.rsplit(b" ", len(names) - 1)
        if len(cells) != len(names) or not cells[0] or not cells[-1].isdigit():
            at = end + 1
            continue
        n = int(cells[-1])
        content = data[end + 1:end + 1 + n]
        yield ArcRecord(version, {k: v.decode("utf-8", "replace") for k, v in zip(names, cells)}, content, len(content) < n)
        at = end + 1 + n


def iso_date(digits: str) -> str:
    """ARC dates have 14 digits, early ones 12 (no seconds)."""
    d = digits if digits.isdigit() and len(digits) in (12, 14) else "19700101000000"
    d = d.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


#: The blank line after an HTTP header; old servers end lines with a bare line feed.
_BLANK = re.compile(rb"\r?\n\r?\n")


def plain(data: bytes) -> bytes:
    """The archive, unpacked if it is compressed."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload) of an HTTP message."""
    m = _BLANK.search(content)
    return (content[:m.end()], content[m.end():]) if m else (content, b"")


def header_value(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record_id(key: str | None, url: str, date: str, digest: str) -> str:
    raw = hashlib.sha256("\n".join((key or "", "" if key else url, "" if key else date, "" if key else digest)).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=raw[:16], version=5)}>"


def to_warc(rec: ArcRecord, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that follow it."""
    date = iso_date(rec.fields["Archive-date"])
    head, payload = b"", rec.content
    lines = []
    key = None
    if rec.url.startswith("filedesc://"):
        kind, mime = "warcinfo", "application/warc-fields"
        payload = (f"software: glossa\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {rec.version}\r\n").encode()
        lines.append(("WARC-Filename", rec.url.removeprefix("filedesc://")))
    else:
        kind, mime = "resource", rec.fields["Content-type"]
        if payload.startswith(b"HTTP/"):
            kind, mime = "response", "application/http; msgtype=response"
            head, payload = split_http(payload)
            key = header_value(head, KEY)
        lines.append(("WARC-Target-URI", rec.url))
        lines.append(("WARC-IP-Address", rec.fields["IP-address"]))
    digest = hashlib.sha256(payload).hexdigest()
    block = head + payload
    if refers_to is not None:
        kind, block = "revisit", head
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, "", "", "")), ("X-Refers-To-Key", refers_to)]
    if rec.truncated:
        lines.append(("WARC-Truncated", "length"))
    if key is not None:
        lines.append((KEY, key))
    first = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key, rec.url, date, digest)), ("WARC-Date", date)]
    last = [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
            ("Content-Type", mime), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (*first, *lines, *last)) + "\r\n"
    return text.encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        n = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + n]
        at = end + 4 + n


def _texts(chunks: list[bytes]) -> pa.RecordBatch:
    """One archive a row.  The text sink writes a string's bytes as they are, so payloads in any
    encoding, images too, go through unchanged."""
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()).view(pa.string())], ["value"])


def _write_arc(batches, version: int, date: str):
    buf, size, n = [], 0, 0

    def close():
        return arc_version_block(version, f"part-{n}.arc", date) + b"\n".join(buf)

    for b in batches:
        for key, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            body = html or b""
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n"
            head += ("" if key is None else f"{KEY}: {key}\r\n") + "\r\n"
            content = head.encode() + body
            buf.append(arc_header(version, url_field(url), date, "text/html", len(content)) + content)
            size += len(buf[-1])
            if size >= ARCHIVE_BYTES:
                yield _texts([close()])
                buf, size, n = [], 0, n + 1
    if buf:
        yield _texts([close()])


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
              version: int = 1, date: str = "20240101000000") -> None:
    """Pages as ARC archives of the given version."""
    p = pages.select(F.col(page_id).cast("string"), F.col(url), F.col(html))
    _save(p.mapInArrow(lambda b: _write_arc(b, version, date), "value string"), path, "\n")


def _save(archives: DataFrame, path: str, end: str) -> None:
    (archives.write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the archives in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _payloads(batches):
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1)):
            out = []
            for i, r in enumerate(parse_arc(plain(data.as_py()))):
                if r.content.startswith(b"HTTP/"):
                    head, payload = split_http(r.content)
                    key = header_value(head, KEY)
                    if key is not None and len(payload) >= REVISIT_BYTES:
                        out.append((path, i, int(key), hashlib.sha256(payload).digest()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
                                             ["path", "i", "key", "digest"])


def _convert(batches):
    for b in batches:
        for data, revisits in zip(b.column(0), b.column(1)):
            refer = {r["i"]: str(r["first"]) for r in revisits.as_py() or ()}
            recs = parse_arc(plain(data.as_py()))
            yield _texts([b"\r\n\r\n".join(to_warc(r, refer.get(i)) for i, r in enumerate(recs))])


def arc_to_warc(spark: SparkSession, arc: str, warc: str) -> None:
    """Converts the ARC archives of a folder to WARC archives in another.
    The source keys are integers."""
    seen = archives(spark, arc).mapInArrow(_payloads, "path string, i bigint, key bigint, digest binary")
    groups = (seen.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"))
              .where("first <> last").select("digest", "first"))
    revisits = (spread_join(seen, groups, ["digest"], ["path", "i"], "inner").where("key <> first")
                .groupBy("path").agg(F.collect_list(F.struct("i", "first")).alias("revisits")))   # within one archive
    both = archives(spark, arc).join(revisits, "path", "left").select("content", "revisits")
    _save(both.mapInArrow(_convert, "value string"), warc, "\r\n\r\n")


def _read_warc(batches):
    for b in batches:
        for data in b.column(1):
            out = []
            for f, block in parse_warc(plain(data.as_py())):
                if f["warc-type"] not in ("response", "revisit"):
                    continue
                head, payload = split_http(block)
                digest = f["warc-payload-digest"].removeprefix("sha256:")
                if f["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {f['warc-record-id']} doesn't have its digest")
                size = len(payload) if f["warc-type"] == "response" else int(header_value(head, "Content-Length"))
                key, first = f.get(KEY.lower()), f.get("x-refers-to-key")
                out.append((f["warc-record-id"], f.get("warc-target-uri"), f["warc-date"], None if key is None else int(key),
                            size, digest, f["warc-type"], None if first is None else int(first)))
            cols = list(zip(*out)) or [[]] * 8
            kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["record_id", "target_uri", "date", "key", "payload_bytes", "payload_digest",
                                              "record_type", "refers_to"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per response and revisit record; payloads are checked against their digests."""
    return archives(spark, path).mapInArrow(
        _read_warc, "record_id string, target_uri string, date string, key bigint, payload_bytes bigint, "
        "payload_digest string, record_type string, refers_to bigint")


def page_records(pages: DataFrame, version: int = 2) -> DataFrame:
    """Pages through both formats: ARC written, converted, and read back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_arc(pages, scratch.path("arc"), version=version)
    arc_to_warc(spark, scratch.path("arc"), scratch.path("warc"))
    scratch.drop("arc")
    return read_warc(spark, scratch.path("warc")).withColumnRenamed("key", "page_id")
