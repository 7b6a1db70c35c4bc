"""Legacy archive converter: ARC files in, WARC files out, with identical payloads turned into revisits.

ARC (versions 1 and 2): a file starts with a `filedesc://` record whose body names the version and the header fields;
each record is one header line, the declared number of bytes, and a line end. Version 1 lines have five fields (URL,
IP, date, content type, length); version 2 lines have ten (… result code, checksum, location, offset, file name,
length). A URL that holds blanks is tolerated: fields are counted from the right. Records are gzip members.

Conversion. Each ARC record becomes one WARC/1.1 record: WARC-Record-ID is a name-based UUID of the ARC file and offset
(so a retried task writes the same record), WARC-Date comes from the 14-digit (or shorter) ARC date, WARC-Type is
warcinfo for filedesc, response for HTTP, resource for others, and block and payload digests are SHA-1 in base32.
Of equal payloads the one with the smallest key (then file and offset) stays; the others become revisit records that
refer to it and keep only their HTTP header.

Distribution. An index (file, offset, key, digest) of small rows is what is shuffled; payloads never are. The index is
aggregated by digest before the join back, so that a digest with a third of all rows is one row on one side and a
splittable run on the other; decisions go back by ARC file, and files are bounded in size.

Edge cases: null payload is empty; null URL is written as `urn:unknown`; repeated keys and payloads are ordered by
place in the archives; an empty table gives no files; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, file_system, shared_dir, spread, text_or_empty

FILE_BYTES = 32 << 20
KEY_HEADER = "X-Archive-Key"
V1, V2 = "URL IP-address Archive-date Content-type Archive-length", "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


class Out:
    """One archive under way: its path, and where the next record starts."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.uri, self.stream, self.at = uri, fs.open_output_stream(path, compression=None), 0

    def add(self, record: bytes) -> tuple[int, int]:
        data = member(record)
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.stream.close()


def arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, code: int = 200, place: int = 0, name: str = "-") -> bytes:
    fields = [url, ip, date, kind, str(length)] if version == 1 else [url, ip, date, kind, str(code), "-", "-", str(place), name, str(length)]
    return " ".join(fields).encode() + b"\n"


def write_arc(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int = 1, date: str = "20240101000000") -> DataFrame:
    """Write rows as ARC files of bounded size; returns their list (path, bytes). Legacy input for the converter.

    The row's key travels in an HTTP header of the record's block, since ARC has no field for it.
    """
    source = pages.select(F.col(key_col).alias("key"), F.col(url_col).cast("string").alias("url"), text_or_empty(payload_col).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in chunks(batches, "payload"):
            for key, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    out = Out(f"{folder}/{name}")
                    body = f"{version} 0 crestline\n{V1 if version == 1 else V2}\n\n".encode()
                    out.add(arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name=name) + body + b"\n")
                data = payload.encode()
                shown = "" if key is None else f"{KEY_HEADER}: {key}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{shown}Content-Length: {len(data)}\r\n\r\n".encode() + data
                clean = "urn:unknown" if not url else url.replace("\n", "%0A").replace("\r", "%0D")
                out.add(arc_line(version, clean, "0.0.0.0", date, "text/html", len(block), place=out.at, name=name) + block + b"\n")
                if out.at >= FILE_BYTES:
                    out.close()
                    done.append((out.uri, out.at))
                    out = None
        if out is not None:
            out.close()
            done.append((out.uri, out.at))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "bytes"])

    return cut(source.mapInArrow(run, "path string, bytes long"))


def members(uri: str, want: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, read a piece at a time; `want` names (offset, length) to fetch."""
    fs, path = file_system(uri)
    if want is not None:
        with fs.open_input_file(path) as f:
            for offset, length in want:
                f.seek(offset)
                yield offset, length, gzip.decompress(f.read(length))
        return
    with fs.open_input_stream(path, compression=None) as f:
        at, rest = 0, b""
        while True:
            unpack, parts, used = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                rest = rest or f.read(1 << 20)
                if not rest:
                    if used:
                        raise ValueError(f"{uri}: the archive ends inside a record")
                    return
                parts.append(unpack.decompress(rest))
                used += len(rest) - len(unpack.unused_data)
                rest = unpack.unused_data
            yield at, used, b"".join(parts)
            at += used


def arc_record(data: bytes, version: int | None) -> dict:
    """Header fields and block of one ARC record; `version` is that of the file's filedesc record, None for itself."""
    line, _, rest = data.partition(b"\n")
    fields = line.decode("utf-8", "replace").rstrip("\r").split(" ")
    own = version or (2 if len(fields) >= 10 else 1)
    count = 5 if own == 1 else 10
    if len(fields) < count or not fields[-1].isdigit():
        raise ValueError(f"not an ARC version {own} header line: {line[:200]!r}")
    length = int(fields[-1])
    if len(rest) < length:
        raise ValueError(f"declared length {length}, found {len(rest)} bytes")
    tail = fields[len(fields) - count + 1 :]
    block = rest[:length]
    if version is None and fields[0].startswith("filedesc://"):
        own = int(block.split(b" ", 1)[0])
    return {"version": own, "url": " ".join(fields[: len(fields) - count + 1]), "ip": tail[0], "date": tail[1], "type": tail[2], "code": int(tail[3]) if own == 2 and tail[3].isdigit() else None, "block": block}


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header bytes (with the blank line), header fields and payload of an HTTP block; no header if it is not HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, sep, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return head + sep, fields, payload


def warc_date(date: str) -> str:
    """ARC dates have 14 digits, or 12 or 8 in old files; what is missing reads as the start of the period."""
    d = "".join(c for c in date if c.isdigit())[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}").urn


def index_arc(files: DataFrame, key_type: str) -> DataFrame:
    """A row per HTTP or other record (not filedesc): path, offset, length, version, key, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, version = [], None
                for offset, length, data in members(path):
                    r = arc_record(data, version)
                    version = r["version"]
                    if r["url"].startswith("filedesc://"):
                        continue
                    _, fields, payload = http_parts(r["block"])
                    rows.append((path, offset, length, version, fields.get(KEY_HEADER), digest(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], ["path", "offset", "length", "version", "key", "digest"])

    out = spread(files, files.count()).mapInArrow(run, "path string, offset long, length long, version int, key string, digest string")
    return out.withColumn("key", F.col("key").cast(key_type))


def decide(index: DataFrame) -> DataFrame:
    """Adds first_*: key, path and offset of the record that stays among those of equal payload."""
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", "path", "offset")
    first = index.groupBy("digest").agg(F.min(order).alias("first"))
    return index.join(first, "digest").select("path", "offset", "length", "version", "key", "digest", F.col("first.key").alias("first_key"), F.col("first.path").alias("first_path"), F.col("first.offset").alias("first_offset"))


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def convert(decided: DataFrame, folder: str) -> DataFrame:
    """Write WARC files from the ARC files; returns their list (path, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, count = None, [], 0
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length", "version", "key", "first_key", "first_path", "first_offset"))))
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end][0] == rows[at][0]:
                    end += 1
                run_rows, path = rows[at:end], rows[at][0]
                at = end
                for (_, offset, length, version, _, first_key, first_path, first_offset), (_, _, data) in zip(run_rows, members(path, [r[1:3] for r in run_rows])):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, count = Out(f"{folder}/{name}"), 0
                        info = b"software: crestline\r\nformat: WARC File Format 1.1\r\n"
                        out.add(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(name, 0)}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
                    out.add(converted(arc_record(data, version), path, offset, first_key, first_path, first_offset))
                    count += 1
                    if out.at >= FILE_BYTES:
                        out.close()
                        done.append((out.uri, out.at, count))
                        out = None
        if out is not None:
            out.close()
            done.append((out.uri, out.at, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "bytes", "records"])

    ordered = decided.repartition("path").sortWithinPartitions("path", "offset")
    return cut(ordered.mapInArrow(run, "path string, bytes long, records long"))


def converted(r: dict, path: str, offset: int, first_key, first_path: str, first_offset: int) -> bytes:
    """The WARC record of one ARC record; a payload that another record holds gives a revisit."""
    head, _, payload = http_parts(r["block"])
    again = (first_path, first_offset) != (path, offset)
    block = head if again else r["block"]
    fields = [("WARC-Type", "revisit" if again else "response" if head else "resource"), ("WARC-Record-ID", f"<{record_id(os.path.basename(path), offset)}>"), ("WARC-Date", warc_date(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response" if head else r["type"])]
    if again:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(os.path.basename(first_path), first_offset)}>")]
        if first_key is not None:
            fields.append(("X-Refers-To-Key", str(first_key)))
    return warc_record(fields, block)


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    length = int(fields["Content-Length"])
    if len(rest) < length:
        raise ValueError("the record is shorter than its declared length")
    return fields, rest[:length]


def read_warc(files: DataFrame) -> DataFrame:
    """A row per response, resource or revisit record: key, url, record_id, record_type, date, refers_to_id,
    refers_to_key, payload_bytes, payload_digest (checked against the payload where the record holds it) and payload
    (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for _, _, data in members(path):
                    fields, block = parse_warc(data)
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and digest(payload) != said:
                        raise ValueError(f"{path}: payload does not match its digest")
                    size = int(http.get("Content-Length", 0)) if kind == "revisit" else len(payload)
                    rows.append((http.get(KEY_HEADER), fields["WARC-Target-URI"], fields["WARC-Record-ID"], kind, fields["WARC-Date"], fields.get("WARC-Refers-To"), fields.get("X-Refers-To-Key"), size, said, None if kind == "revisit" else payload))
                    held += len(payload)
                    if held >= 4 << 20:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    names = ["key", "url", "record_id", "record_type", "date", "refers_to_id", "refers_to_key", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return spread(files, files.count()).mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in zip(names, kinds)))


def archive(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int = 1, folder: str | None = None) -> DataFrame:
    """Rows to ARC files, ARC to WARC, and the WARC records read back."""
    folder = folder or shared_dir(pages.sparkSession)
    kind = pages.schema[key_col].dataType.simpleString()
    arcs = write_arc(pages, f"{folder}/arc", key_col, url_col, payload_col, version)
    warcs = convert(decide(cut(index_arc(arcs, kind))), f"{folder}/warc")
    back = read_warc(warcs)
    return back.withColumn("key", F.col("key").cast(kind)).withColumn("refers_to_key", F.col("refers_to_key").cast(kind))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = archive(pages)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


# A base32 digit is five bits: five hexadecimal digits make four of them.
SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(encode(h)) AS hex FROM d),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        ((('0x' || hex[(i // 4) * 5 + 1 : (i // 4) * 5 + 5])::INT >> (15 - 5 * (i % 4))) & 31) + 1]), 'string_agg', '') AS payload_digest,
      min(page_id) OVER (PARTITION BY hex) AS first FROM x)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
