"""WARC: a converter of legacy ARC archives, with the writers and readers of both.

ARC: a version block names the header fields (version 1 has five, version 2 ten); each record is a header line of these
fields, the last being the length in bytes, then so many bytes and a line feed. The converter parses header lines by
the archive's version, takes declared lengths at their word, and synthesises what WARC adds: record identifiers, ISO
timestamps, record types and digests. Records with equal payloads become one response and revisits of it.

Archives are gzip members of one record each. They are written by Spark's text writer, one row per archive of about
`ARCHIVE_BYTES`, and read by Spark's binaryFile source, so any store that Spark knows will do. An archive is the unit
of work and bounds a task's memory. Which records repeat is found on narrow (digest, page) records and joined to
archives by path; payloads are never shuffled by digest, so a page with a third of all copies is no hot key.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import map_batches, stored, table
from barloom.sources.session import shared_folder

ARCHIVE_BYTES = 4 << 20   # compressed bytes after which a writer begins the next archive
#: The header fields of the two versions of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_END = b"\r\n\r\n"
_STEP = 1 << 14  # bytes given to the decompressor at once


def member(record: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def members(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member; what follows the last one is ignored."""
    view, at = memoryview(archive), 0
    while archive[at:at + 2] == b"\x1f\x8b":
        reader, parts, upto = zlib.decompressobj(31), [], at
        while not reader.eof:
            if upto >= len(archive):
                raise ValueError("an archive ends within a record")
            parts.append(reader.decompress(view[upto:upto + _STEP]))
            upto += _STEP
        yield at, b"".join(parts)
        at = min(upto, len(archive)) - len(reader.unused_data)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC ---------------------------------------------------------------------------------------------------------

def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 barloom\n{ARC_FIELDS[version]}\n".encode()
    extra = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, name: str, offset: int, body: bytes) -> bytes:
    extra = f" 200 {sha1_base32(body)} - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{extra} {len(body)}\n".encode() + body + b"\n"


def read_arc(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, body) of every record after the version block, by the field names that it declares."""
    names: list[str] = []
    for offset, record in members(archive):
        line, _, rest = record.partition(b"\n")
        if not names:
            length = int(line.split(b" ")[-1])
            names = rest[:length].split(b"\n")[1].decode().split(" ")
            continue
        # Only the URL may hold spaces: the other fields are taken from the right.
        fields = dict(zip(names, line.decode("utf-8", "replace").rsplit(" ", len(names) - 1), strict=True))
        yield offset, fields, rest[:int(fields["Archive-length"])]


# --- HTTP --------------------------------------------------------------------------------------------------------

def http_response(page_id: int | None, mime: str, payload: bytes) -> bytes:
    number = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n{number}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_http(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = body.partition(_END)
    lines = (line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:])
    return {k.lower(): v for k, v in lines}, payload


# --- WARC --------------------------------------------------------------------------------------------------------

def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + _END


def read_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for _, record in members(archive):
        head, _, rest = record.partition(_END)
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[:int(headers["Content-Length"])]


def record_id(url: str, date: str, digest: str, page_id: int | None) -> str:
    """The same record gets the same identifier whenever it is converted."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {digest} {page_id}").urn


def iso(date: str) -> str:
    """A 14-digit ARC date as a WARC timestamp; shorter ones are filled up."""
    d = date + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(fields: dict[str, str], body: bytes, refers: tuple[int | None, str] | None) -> bytes:
    """The WARC record of an ARC record; `refers`: page and record that it revisits, or None."""
    url, date = fields["URL"], iso(fields["Archive-date"])
    if not body.startswith(b"HTTP/"):  # DNS answers and the like
        digest = sha1_base32(body)
        return warc_record("resource", [("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", f"<{record_id(url, date, digest, None)}>"),
                                        ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Type", fields["Content-type"])], body)
    http, payload = split_http(body)
    number, digest = http.get("x-page-id"), sha1_base32(payload)
    own = record_id(url, date, digest, None if number is None else int(number))
    headers = [
        ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", f"<{own}>"), ("WARC-IP-Address", fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ] + [("X-Page-Id", number)] * (number is not None)
    if refers is None:
        return warc_record("response", [*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(body)}")], body)
    page, target = refers
    return warc_record("revisit", [
        *headers, ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{target}>"),
    ] + [("X-Refers-To-Page-Id", str(page))] * (page is not None), body[:len(body) - len(payload)])


# --- Spark -------------------------------------------------------------------------------------------------------

def _write_archives(archives: DataFrame, path: str) -> None:
    """One file per row of `archive`; the writer's line end after it is skipped by readers."""
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = "20010101000000", ip: str = "0.0.0.0", page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as ARC archives, versions 1 and 2 in turn. A null html is an empty payload, a null url is `-`, white space in a url is escaped; a null page_id is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = number = 0
        name, version = "", 1
        for batch in batches:
            for key, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    number += 1
                    version, name = 2 - number % 2, f"{number:06d}.arc.gz"
                    parts = [member(arc_version_block(version, name, date))]
                    size = len(parts[0])
                link = "%20".join((at or "-").split()) or "-"
                mime = "text/html"
                parts.append(member(arc_record(version, link, ip, date, mime, name, size, http_response(key, mime, (text or "").encode()))))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"archive": [b"".join(parts)]})
                    parts = []
        if parts:
            yield pa.RecordBatch.from_pydict({"archive": [b"".join(parts)]})

    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    _write_archives(map_batches(rows, run, "archive binary"), path)


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, page_id, url, date, record, bytes, digest) of every HTTP record in ARC archives; no payloads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "page_id", "record", "bytes", "digest"]
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for offset, fields, body in read_arc(content):
                    if body.startswith(b"HTTP/"):
                        http, payload = split_http(body)
                        number, digest = http.get("x-page-id"), sha1_base32(payload)
                        number = None if number is None else int(number)
                        rows.append((file, offset, number, record_id(fields["URL"], iso(fields["Archive-date"]), digest, number), len(payload), digest))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return map_batches(_read_archives(spark, path), run, "path string, offset bigint, page_id bigint, record string, bytes bigint, digest string")


def revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(path, offset, page, record): for every record that repeats another's payload, that other one.

    Of equal payloads of at least `least_bytes` the largest page_id is the response, of equal page_ids the last place.
    Only payloads that occur twice are joined, and within such a group the records of a path are dealt on their own.
    """
    rows = index.where(F.col("bytes") >= least_bytes)
    most = F.max(F.struct("page_id", "path", "offset", "record")).alias("r")
    groups = rows.groupBy("digest", "bytes").agg(most, F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        rows.join(groups, ["digest", "bytes"]).where("not (path = r.path and offset = r.offset)")
        .select("path", "offset", F.col("r.page_id").alias("page"), F.col("r.record").alias("record"))
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Convert ARC archives to WARC archives, one each."""
    again = stored(revisits(stored(arc_index(spark, arc_path)), least_bytes))
    by_archive = again.groupBy("path").agg(F.collect_list(F.struct("offset", "page", "record")).alias("again"))  # at most an archive's records
    work = _read_archives(spark, arc_path).join(by_archive, "path", "left").select("path", "content", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = {x["offset"]: (x["page"], x["record"]) for x in again or []}
                info = f"software: barloom\r\nformat: WARC File Format 1.0\r\nconverted-from: {path.rsplit('/', 1)[-1]}\r\n".encode()
                parts = [member(warc_record("warcinfo", [("WARC-Date", "2001-01-01T00:00:00Z"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, path).urn}>"), ("Content-Type", "application/warc-fields")], info))]
                parts += [member(to_warc(fields, body, known.get(offset))) for offset, fields, body in read_arc(content)]
                yield pa.RecordBatch.from_pydict({"archive": [b"".join(parts)]})

    _write_archives(map_batches(work, run, "archive binary"), warc_path)


def read_warc_records(spark: SparkSession, path: str) -> DataFrame:
    """Per HTTP record of WARC archives: page_id, url, warc_date, record_type, payload_bytes, payload_digest, refers_to.

    Lengths are of the full payload, for revisits as their HTTP header declares it.
    """
    schema = "page_id bigint, url string, warc_date string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1).to_pylist():
                rows = []
                for h, block in read_warc(content):
                    if h["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, payload = split_http(block)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"digest of {h['WARC-Record-ID']} does not match its payload")
                    rows.append((number(h.get("X-Page-Id")), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Type"], int(http["content-length"]), digest, number(h.get("X-Refers-To-Page-Id"))))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return map_batches(_read_archives(spark, path), run, schema)


def through_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row per page.

    Null html is an empty payload; empty payloads are equal payloads. A null page_id loses against known ones. Repeated
    rows are records of their own, of which one is the response. An empty table gives an empty result. Other columns are not read.
    """
    spark, base = pages.sparkSession, shared_folder(pages.sparkSession)
    write_arc(pages, f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc", least_bytes)
    return read_warc_records(spark, f"{base}/warc")


def op4_warc(spark, sf_dir):
    return through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as s from p),
n as (select page_id, payload_bytes, s,
        list_transform(range(8), lambda k: ('0x' || substr(s, 1 + 5 * k, 5))::bigint) as v,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as a from d),
b as (select page_id, payload_bytes, s, array_to_string(list_transform(v, lambda x:
        substr(a, 1 + ((x >> 15) & 31), 1) || substr(a, 1 + ((x >> 10) & 31), 1) || substr(a, 1 + ((x >> 5) & 31), 1) || substr(a, 1 + (x & 31), 1)), '') as payload_digest from n)
select page_id, payload_bytes, payload_digest,
       case when page_id = max(page_id) over w then 'response' else 'revisit' end as record_type,
       case when page_id < max(page_id) over w then max(page_id) over w end as refers_to
from b window w as (partition by s)
"""
