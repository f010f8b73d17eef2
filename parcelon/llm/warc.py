"""From legacy ARC archives to WARC archives.

ARC files start with a version block that names the fields of the header lines to come: version 1
has URL, address, date, type and length; version 2 adds result code, checksum, location, offset
and file name before the length. A record is its header line, then as many bytes as the line
declares. The converter parses the lines by the version of their file, and makes equivalent WARC
records: record ids derived from address, date, digest and key (the same input gives the same
id), ISO dates, record types (http(s) addresses are responses, the version block is a warcinfo,
all else a resource), payload and block digests. Of records with equal payloads of some size the
one with the largest key stays a response and the others become revisits of it.

Archives are gzipped and written by Spark's text writer, which puts raw bytes into any file
system under its commit protocol; the line feed that it adds is the one that ends an ARC record,
and the two blank lines are those that end a WARC record. Payloads are never recoded.

An archive is read as one binary value, so its file must stay below 2 GB; a file holds one input
partition, which spark.sql.files.maxPartitionBytes bounds.

Defined cases: a null payload is empty; a payload of any length is one record; a null or odd address is written percent-encoded (null as
"-"); rows that repeat key and payload are all responses; rows with a null key take part and are
revisits if another row has a key; an empty table gives archives without records and no rows;
further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
KEY_FIELD = "X-Record-Key"
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Bytes of payload in one Arrow batch.
BATCH_BYTES = 4 << 20


def arc_line(version: int, url: str, ip: str, date: str, mime: str, length: int, name: str, status: int = 200, offset: int = 0) -> bytes:
    rest = f"{length}" if version == 1 else f"{status} - - {offset} {name} {length}"
    return f"{url} {ip} {date} {mime} {rest}\n".encode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 parcelon\n{' '.join(FIELDS[version])}\n\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name) + body


def arc_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an ARC file as dicts of its fields (in lower case) and the content."""
    version = 1
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if text.startswith("filedesc://"):
            length = int(text.rsplit(" ", 1)[1])
            content = stream.read(length)
            version = int(content[:1])
            names = FIELDS.get(version)
            if names is None:
                raise ValueError(f"ARC version {version}")
        else:
            length, content = None, b""
        names = FIELDS[version]
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError("an ARC header line with missing fields")
        found = {n.lower(): v for n, v in zip(names, parts, strict=True)}
        found["version"] = version
        if length is None:
            content = stream.read(int(found["archive-length"]))
            if len(content) != int(found["archive-length"]):
                raise ValueError("an ARC record shorter than declared")
        found["content"] = content
        yield found


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message."""
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (b"", content)


def head_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(name.lower().encode() + b":"):
            return line.split(b":", 1)[1].strip().decode("utf-8", "replace")
    return None


def record_id(url: str, date: str, digest: str, key: str | None) -> str:
    made = hashlib.sha1(f"{url}\n{date}\n{digest}\n{key}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=made, version=5)}>"


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two blank lines at its end."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: {sha1_label(block)}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """Header fields (in lower case) and block of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a WARC record shorter than declared")
        yield fields, block


def batches_of(rows: Iterable[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded bytes; weight: the place of the bytes column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + 200
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_BYTES = pa.schema([("value", pa.binary())])


def write_text(records: DataFrame, path: str, end: str) -> None:
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def opened(content: bytes) -> io.BufferedIOBase:
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def write_arc(pages: DataFrame, path: str, key: str, url: str, payload: Column, date: str = "20200101000000") -> None:
    """Pages as ARC files of versions 1 and 2 in turn, one file for each input partition."""
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:06d}.arc"

        def records():
            yield (arc_version_block(version, name, date)[:-1],)  # the writer adds the line feed
            for batch in batches:
                for k, u, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(body)}\r\n" + (f"{KEY_FIELD}: {k}\r\n" if k is not None else "") + "\r\n"
                    content = head.encode() + body
                    yield (arc_line(version, quote(u, safe=":/?#[]@!$&'()*+,;=%~") if u else "-", "0.0.0.0", date, "text/html", len(content), name) + content,)

        yield from batches_of(records(), _BYTES, 0)

    write_text(rows.mapInArrow(make, "value binary"), path, "\n")


_ARC = pa.schema([("key", pa.string()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary())])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Per record (without version blocks): key, url, date, mime, head, payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content in batch.column(1):
                    for r in arc_records(opened(content.as_py())):
                        if not r["url"].startswith("filedesc://"):
                            head, payload = split_http(r["content"]) if r["url"].startswith("http") or r["content"][:5] == b"HTTP/" else (b"", r["content"])
                            yield head_field(head, KEY_FIELD), r["url"], r["archive-date"], r["content-type"], head, payload

        yield from batches_of(rows(), _ARC, 5)

    return archive_files(spark, path).mapInArrow(parse, "key string, url string, date string, mime string, head binary, payload binary")


def convert(spark: SparkSession, arc_path: str, warc_path: str, folder: str, least: int = REVISIT_BYTES) -> None:
    """ARC files to WARC files; see the module."""
    found = read_arc(spark, arc_path).withColumn("digest", F.sha2("payload", 256))
    # Digests of payloads that occur more than once, with the record that stays; read from a
    # table, so that Spark knows its size and broadcasts it only if it is small.
    rank = F.struct(F.col("key").cast("decimal(38,0)").alias("order"), "key", "url", "date")
    first = found.where(F.octet_length("payload") >= least).select("digest", rank.alias("r")).groupBy("digest").agg(F.max("r").alias("r"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("digest", F.col("r.key").alias("okey"), F.col("r.url").alias("ourl"), F.col("r.date").alias("odate")), folder, "originals")
    joined = found.join(first, "digest", "left").withColumn("revisit", F.col("okey").isNotNull() & ~F.col("okey").eqNullSafe(F.col("key")))
    rows = joined.select("key", "url", "date", "mime", "head", F.col("payload"), "revisit", "okey", "ourl", "odate")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            info = b"software: parcelon\r\nformat: WARC File Format 1.1\r\n"
            part = f"part-{TaskContext.get().partitionId():06d}"
            yield (warc_record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", "", part, None)), ("WARC-Date", iso_date("20200101000000")), ("Content-Type", "application/warc-fields")], info),)
            for batch in batches:
                for key, url, date, mime, head, payload, revisit, okey, ourl, odate in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                    digest, http = hashlib.sha1(payload).hexdigest(), bool(head)
                    fields = [("WARC-Record-ID", record_id(url, date, digest, key)), ("WARC-Date", iso_date(date)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", sha1_label(payload)), ("Content-Type", "application/http; msgtype=response" if http else mime)]
                    if revisit:
                        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(ourl, odate, digest, okey)), ("WARC-Refers-To-Target-URI", ourl), ("WARC-Refers-To-Date", iso_date(odate)), (f"{KEY_FIELD}-Refers-To", okey)]
                        yield (warc_record("revisit", fields, head),)
                    else:
                        yield (warc_record("response" if http else "resource", fields, head + payload),)

        yield from batches_of(records(), _BYTES, 0)

    write_text(rows.mapInArrow(make, "value binary"), warc_path, "\r\n\r\n")


_WARC = pa.schema([("key", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_id", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Per response, resource or revisit: the fields of _WARC; a revisit has no payload of its own,
    and its length and digest are those its header declares."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content in batch.column(1):
                    for f, block in warc_records(opened(content.as_py())):
                        kind = f["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        head, payload = split_http(block) if kind != "resource" else (b"", block)
                        declared = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind != "revisit" and declared != hashlib.sha1(payload).hexdigest():
                            raise ValueError("a payload other than its digest says")
                        size = int(head_field(head, "Content-Length") or 0) if kind == "revisit" else len(payload)
                        yield head_field(head, KEY_FIELD), f["warc-record-id"], f.get("warc-target-uri"), f["warc-date"], kind, declared, size, f.get("warc-refers-to"), f.get(f"{KEY_FIELD}-Refers-To".lower()), payload if payloads and kind != "revisit" else None

        yield from batches_of(rows(), _WARC, 9)

    kinds = "key string, record_id string, url string, date string, record_type string, payload_digest string, payload_bytes long, refers_to_id string, refers_to string, payload binary"
    return archive_files(spark, path).mapInArrow(parse, kinds)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    write_arc(table(spark, sf_dir, "pages"), f"{folder}/arc", "page_id", "url", payload)
    convert(spark, f"{folder}/arc", f"{folder}/warc", folder)
    rows = read_warc(spark, f"{folder}/warc", payloads=False)
    return rows.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, body, strlen(body) AS n, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
