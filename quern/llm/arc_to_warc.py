"""Legacy archives: ARC files read by their version's header lines and declared lengths, written as WARC.

ARC names no record ids, types or digests; they are synthesised from what the record has, so the
same archive always gives the same WARC records.  Records whose payload occurred before become
revisits.  All bytes pass through Spark's readers and writers; each record is a gzip member of its own,
and each file begins with a warcinfo record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import shared_dir, small_or_not, table, written

# The fields of a record's header line, by version of the archive.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
#: Bytes of records in a WARC file, before compression, from which the next record begins another; a file is read by one task.
FILE_BYTES = 64 << 20
#: Bytes in an Arrow batch, from which the next record begins another.
BATCH_BYTES = 8 << 20
#: A gzip member ends with its size, so this byte is the last of one that holds less than 16 MB.
_LAST, _MEMBER_BYTES = b"\x00", 8 << 20


def _line(fields: list[str]) -> bytes:
    return (" ".join(fields) + "\n").encode("utf-8")


def _field(value: str | None, default: str) -> str:
    """A header field: white space would end it, so its UTF-8 bytes are percent-encoded."""
    return "".join(quote(c, safe="") if c.isspace() or ord(c) < 32 else c for c in value or "") or default


def build_arc(records: list[tuple[str | None, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, date, content type, content) records."""
    head = f"{version} 0 quern\n{ARC_NAMES[version]}\n\n".encode()
    extra = ["200", "-", "-", "0", name] if version == 2 else []
    out = [_line([f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", *extra, str(len(head))]), head]
    for url, date, content_type, content in records:
        out += [b"\n", _line([_field(url, "about:blank"), "0.0.0.0", date, _field(content_type, "no-type"), *extra, str(len(content))]), content]
    return b"".join(out) + b"\n"


# a header line is read from what can't be mistaken: the address and date before the content type, and the fields at its end
_BEGIN = r"(?P<url>.*) (?P<ip>[0-9A-Fa-f:.]+|-) (?P<date>[0-9]{4,14}) (?P<content_type>.*\S)"
_HEADERS = {1: re.compile(_BEGIN + r" (?P<length>[0-9]+)"), 2: re.compile(_BEGIN + "".join(f" (?P<{f}>\\S+)" for f in ARC_FIELDS[2][4:-1]) + r" (?P<length>[0-9]+)")}


def parse_arc(content: bytes, strict: bool = True) -> Iterator[dict]:
    """The records of an ARC file, of either version and gzipped or not: its header fields and ``content``.

    The version block tells the version; each content is taken by its declared length, whatever
    it holds.  URLs and content types may hold blanks.  A header line that doesn't fit the version, or a length beyond
    the end, is an error, raised if ``strict`` and else given as a record of ``error`` and ``content`` (what was there); after
    one whose length isn't known or isn't there, nothing more can be read.
    """

    def bad(reason: str, held: bytes) -> dict:
        if strict:
            raise ValueError(reason)
        return {"error": reason, "content": held}

    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError, zlib.error) as e:
            yield bad(f"an ARC file is no gzip file: {e}", content)
            return
    at, version = 0, 0
    while at < len(content):
        end = content.find(b"\n", at)
        if end == at:  # the newline between records
            at += 1
            continue
        if end < 0:
            yield bad("an ARC header line has no end", content[at:])
            return
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        length = line.rpartition(" ")[2]
        if not (length.isascii() and length.isdigit()):
            yield bad("an ARC header line has no length", content[at:])
            return
        size = int(length)
        body = content[end + 1 : end + 1 + size]
        if len(body) < size:
            yield bad("an ARC record ends before its declared length", content[at:])
            return
        begun, at = at, end + 1 + size
        if not version:
            told = body.split(b" ", 1)[0]
            if not line.startswith("filedesc://") or not told.isdigit() or int(told) not in ARC_FIELDS:
                yield bad("an ARC file begins with a version block of a known version", content)
                return
            version = int(told)
            continue
        fields = _HEADERS[version].fullmatch(line)
        yield fields.groupdict() | {"content": body} if fields else bad(f"an ARC {version} header line has other fields: {line[:200]}", content[begun:at])


#: The date of a record whose own is none.
NO_DATE = "1970-01-01T00:00:00Z"


def _warc_date(date: str) -> str:
    """A WARC timestamp of an ARC date of 14 digits, or of its first 4 to 12; NO_DATE if there is no such time."""
    d = date + "00000101000000"[len(date) :] if len(date) < 14 else date
    try:
        return datetime.strptime(d, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return NO_DATE


def record_id(key: str) -> str:
    h = hashlib.sha256(key.encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


RECORD = "key long, id string, date string, uri string, content_type string, http binary, payload binary, digest string, error string"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    types = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.string(), pa.string()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    for batch in batches:
        for content, keys in zip(batch.column(0), batch.column(1), strict=True):
            if not content.is_valid:
                continue
            content, keys = content.as_py(), keys.as_py()
            archive = hashlib.sha256(content).hexdigest()
            rows, size = [], 0
            for i, r in enumerate(parse_arc(content, strict=False)):
                body, http, error = r["content"], b"", r.get("error")
                if error is None and body[:5] == b"HTTP/" and (cut := body.find(b"\r\n\r\n")) >= 0:
                    http, body = body[: cut + 4], body[cut + 4 :]
                digest = hashlib.sha256(body).hexdigest()
                key = keys[i] if keys is not None and i < len(keys) else None
                rows.append((key, record_id(f"{archive} {i} {digest}"), _warc_date(r.get("date", "")), r.get("url"), r.get("content_type"), http, body, digest, error))
                size += len(body)
                if size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def convert_arc(archives: DataFrame) -> DataFrame:
    """The records of ARC files, as WARC fields: RECORD.

    ``archives`` has ``content`` (binary; null: none) and ``keys`` (an array of longs, one per
    record in order, or null, as ARC has no field for them: then keys are null).  An HTTP header at the start of a record is
    split from its payload.  What can't be read is a record with an ``error``, its bytes the payload: it is never
    written as a WARC record, and fails no other.  An id is made of the archive's digest, the record's place in it and its
    payload's digest: the same for the same archive, and no two records of different archives share one.
    """
    return archives.select("content", "keys").mapInArrow(_convert, RECORD)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, html = batch.columns
        size, cuts = 0, [0]
        lengths = np.asarray(pc.fill_null(pc.binary_length(html), 0))
        for i, n in enumerate(lengths.tolist()):
            size += n
            if size >= 1 << 20:
                cuts.append(i + 1)
                size = 0
        for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], batch.num_rows], strict=True)):
            records = []
            for url, text in zip(urls.slice(lo, hi - lo).to_pylist(), html.slice(lo, hi - lo).to_pylist(), strict=True):
                body = (text or "").encode("utf-8")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                records.append((url, "20080601120000", "text/html", head + body))
            if records:
                yield pa.RecordBatch.from_arrays([pa.array([build_arc(records, 1 + k % 2)], pa.binary()), pa.array([ids.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64()))], ["content", "keys"])


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """ARC files (``content``, ``keys``) of ``pages``, about 1 MB each, of both versions by turns.

    A null html is an empty record, a null url ``about:blank``; rows that repeat a page_id are records of their own.
    """
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_pack, "content binary, keys array<long>")


def with_revisits(records: DataFrame) -> DataFrame:
    """``records`` (a written table) with ``type`` and, of revisits, ``refers`` (key, id, uri and date of the stored record).

    Of equal payloads of REVISIT_BYTES or more, the record with the least key is stored, and so
    are records that repeat its key; records without a key are always stored.  Payloads aren't
    shuffled where the ids of revisits fit a broadcast, and never by a digest that many share.
    """
    narrow = records.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("key").isNotNull() & F.col("error").isNull()).select("digest", "key", "id", "uri", "date")
    stored = narrow.groupBy("digest").agg(F.min(F.struct("key", "id", "uri", "date")).alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = narrow.join(small_or_not(written(stored.drop("n"))), "digest").where("key > refers.key").select("id", "refers")
    return records.join(small_or_not(written(again)), "id", "left").withColumn("type", F.when(F.col("refers").isNull(), "response").otherwise("revisit"))


def _member(record: bytes, size: int = _MEMBER_BYTES) -> Iterator[bytes]:
    """A record as a gzip member, or as several where it is longer than ``size``, each without its last byte."""
    for lo in range(0, len(record), size):
        yield gzip.compress(record[lo : lo + size], 6, mtime=0)[:-1]


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in fields if value is not None]
    return ("WARC/1.1\r\n" + "".join(lines) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def _members(file_bytes: int):
    """Gzip members of records, and the number of the file that they go to, among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, batch_size = 0, None, 0
        files: list[int] = []
        out: list[bytes] = []
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                refers = r["refers"] or {}
                # a plain resource has no HTTP header; either way a revisit's block leaves the payload out
                block = r["http"] + (b"" if refers else r["payload"])
                record = _header(
                    [
                        ("WARC-Type", r["type"]), ("WARC-Record-ID", f"<{r['id']}>"), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]),
                        ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("WARC-Refers-To", refers and f"<{refers['id']}>" or None),
                        ("WARC-Refers-To-Target-URI", refers.get("uri")), ("WARC-Refers-To-Date", refers.get("date")), ("WARC-Profile", REVISIT_PROFILE if refers else None),
                        ("X-Key", r["key"]), ("X-Refers-To-Key", refers.get("key")), ("X-Payload-Length", len(r["payload"])),
                        ("Content-Type", "application/http; msgtype=response" if r["http"] else r["content_type"]),
                    ],
                    block,
                )
                if held is None or held >= file_bytes:
                    file, held = file + (held is not None), 0
                    about = b"software: quern\r\nformat: WARC File Format 1.1\r\n"
                    info = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id('info ' + r['id'])}>"), ("WARC-Date", r["date"]), ("Content-Type", "application/warc-fields")], about)
                    record_parts = [*_member(info), *_member(record)]
                else:
                    record_parts = list(_member(record))
                held += len(record)
                for part in record_parts:
                    files.append(file)
                    out.append(part)
                    batch_size += len(part)
                if batch_size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(out, pa.binary())], ["file", "value"])
                    files, out, batch_size = [], [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(out, pa.binary())], ["file", "value"])

    return run


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """``records`` (with_revisits) as gzipped WARC files in ``path``, of about ``file_bytes`` of records, or one longer record, each.

    A task's files lie in folders by their number.  Spark's text writer puts a line end after each row; here that
    is the byte which every member ends with, so the files are plain members one after another.
    """
    names = ["key", "id", "date", "uri", "content_type", "http", "payload", "digest", "type", "refers"]
    rows = records.where("error is null").select(*names).mapInArrow(_members(file_bytes), "file int, value binary")
    rows = rows.select("file", F.col("value").cast("string").alias("value"))  # bytes as they are
    rows.write.partitionBy("file").option("compression", "none").option("lineSep", _LAST.decode()).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, read by declared length."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends before its declared length")
        yield headers, block


READ = "key long, type string, payload_bytes long, payload_digest string, refers_to long, id string, uri string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    whole = lambda x: None if x is None else int(x)
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for h, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(memoryview(content.as_buffer()))))):
                if h["warc-type"] == "warcinfo":
                    continue
                digest = h["warc-payload-digest"].removeprefix("sha256:")
                size = whole(h.get("x-payload-length"))
                if h["warc-type"] == "response":
                    payload = block[block.find(b"\r\n\r\n") + 4 :] if block[:5] == b"HTTP/" else block
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {h['warc-record-id']} doesn't have its digest")
                    size = len(payload)
                rows.append((whole(h.get("x-key")), h["warc-type"], size, digest, whole(h.get("x-refers-to-key")), h["warc-record-id"].strip("<>"), h.get("warc-target-uri")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """READ of every record but warcinfo of the gzipped WARC files in ``path``; stored payloads are held against their digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read, READ)


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` through both archives; a null html is an empty payload, repeats and nulls are as ``with_revisits`` says."""
    records = written(convert_arc(pages_as_arc(table(spark, sf_dir, "pages"))))
    path = shared_dir(spark)
    write_warc(with_revisits(records), path)
    return read_warc(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
