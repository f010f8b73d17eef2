"""Token ids in binary files of shuffled bit or byte planes.

A file holds the ids of consecutive documents, each closed by an end id, in blocks of a fixed
number of ids. A block is transposed into planes (the lowest byte, or bit, of all its ids, then
the next ...); each plane is compressed with zstandard on its own, so that the planes of high
bits shrink to nothing. A chunk index (place, ids and plane lengths of each block) and a
document index (id and number of ids of each document) end the file:

    block frames | index frame | 8 bytes: length of the index frame, little-endian | magic

Each frame is followed by a line feed, because the files are written by Spark's text writer: it
puts raw bytes into any file system Spark knows, under its commit protocol, so a task that is
lost and run again leaves one copy. Readers find everything by the declared lengths.

Defined cases: a null text is empty and yields its end id; a text of any length is encoded whole,
its ids run on over as many blocks as they need; documents are ordered by doc_id, null ids first,
equal ids by a hash of the text and then the text; repeated rows stay apart; an empty table gives no
files that hold documents and no rows; further columns are ignored. A file is read as one binary
value, so it must stay below 2 GB: FILE_BYTES bounds the text in it, but for one longer document.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_file, word_bpe
from .common import parts_for, running_total, shared_dir, table, text_of, written

MAGIC = b"PLANES01"
BLOCK_IDS = 65_536
#: Text bytes for one file.
FILE_BYTES = 24 << 20


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [octets[i].tobytes() for i in range(4)]
    return [np.packbits((octets[i] >> b) & 1).tobytes() for i in range(4) for b in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for i in range(4):
            out[:, i] = np.frombuffer(planes[i], np.uint8)
    else:
        for i in range(4):
            for b in range(8):
                out[:, i] |= np.unpackbits(np.frombuffer(planes[8 * i + b], np.uint8), count=n) << b
    return out.reshape(-1).view("<u4")


def frames(docs: Iterable[tuple[int | None, bytes]], block: int = BLOCK_IDS, kind: str = "byte") -> Iterator[bytes]:
    """The frames of one file; docs gives each document's id and ids (four bytes each)."""
    pack = zstandard.ZstdCompressor(level=3)
    chunks, keys, counts, held, size, at = [], [], [], [], 0, 0

    def close(raw: bytes) -> bytes:
        nonlocal at
        planes = [pack.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), kind)]
        frame = b"".join(planes)
        chunks.append([at, len(raw) // 4, *map(len, planes)])
        at += len(frame) + 1
        return frame

    for key, ids in docs:
        keys.append(key)
        counts.append(len(ids) // 4)
        held.append(ids)
        size += len(ids)
        if size >= 4 * block:
            raw = b"".join(held)
            whole = len(raw) // (4 * block) * 4 * block
            for i in range(0, whole, 4 * block):
                yield close(raw[i : i + 4 * block])
            held, size = [raw[whole:]], len(raw) - whole
    if size:
        yield close(b"".join(held))
    if keys:
        index = pack.compress(json.dumps({"kind": kind, "chunks": chunks, "docs": keys, "counts": counts}).encode())
        yield index + struct.pack("<Q", len(index)) + MAGIC


def read_file(content: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """Each document of a file: its id, the ids of the file before it, its ids as bytes."""
    if not content:
        return
    if content[-9:-1] != MAGIC:
        raise ValueError("not a whole plane file")
    (length,) = struct.unpack("<Q", content[-17:-9])
    index = json.loads(zstandard.decompress(content[-17 - length : -17]))
    unpack, raw, start, chunk = zstandard.ZstdDecompressor(), b"", 0, iter(index["chunks"])
    place = 0
    for key, n in zip(index["docs"], index["counts"], strict=True):
        parts, have = [raw[place:]], len(raw) - place
        if have >= 4 * n:
            ids, place = raw[place : place + 4 * n], place + 4 * n
        else:
            while have < 4 * n:
                at, count, *sizes = next(chunk)
                planes = []
                for s in sizes:
                    planes.append(unpack.decompress(content[at : at + s]))
                    at += s
                parts.append(from_planes(planes, count, index["kind"]).tobytes())
                have += 4 * count
            raw = b"".join(parts)
            ids, place = raw[: 4 * n], 4 * n
        yield key, start, ids
        start += n


def write_ids(docs: DataFrame, path: str, spec: str, end_id: int = 0, block: int = BLOCK_IDS, kind: str = "byte", text: str = "text", key: str = "doc_id") -> None:
    """Encode all documents and write them, in ascending order of the key, below path."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(spec)
        docs = ((k, bpe.ids(t) + end) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for frame in frames(docs, block, kind):
            yield pa.record_batch([pa.array([frame], pa.binary())], ["frame"])

    # Rows of one id are told apart by their texts, copies of a row by a number, so that no id, nor
    # any one text, fills a file of its own; copies are alike, whichever comes first.
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts_for(total, FILE_BYTES), "doc_id", "h", "copy").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: file, doc_id, local_start, n_tokens, ids (binary)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                for k, start, ids in read_file(content):
                    held.append((file, k, start, len(ids) // 4, ids))
                    size += len(ids)
                    if size > 8 << 20:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, doc_id long, local_start long, n_tokens long, ids binary")


def with_crc32(rows: DataFrame) -> DataFrame:
    """ids_crc32 in place of ids."""
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def part_number(file: Column) -> Column:
    """The writer's number of a file; names have five digits or more, so their text does not order them."""
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).cast("long")


def placed(rows: DataFrame, folder: str) -> DataFrame:
    """rows (file, local_start, n_tokens, ...) with start: the ids of all documents before."""
    rows = rows.withColumn("part", part_number(F.col("file")))
    files = running_total(rows.groupBy("part").agg(F.sum("n_tokens").alias("size")), "part", "size", "base", folder, "files")
    return rows.join(files.select("part", "base"), "part").withColumn("start", F.col("base") + F.col("local_start"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_ids(table(spark, sf_dir, "documents"), f"{folder}/ids", tokenizer_file("byte_bpe_50k.json"), end_id=0)
    rows = written(with_crc32(read_ids(spark, f"{folder}/ids")), folder, "read-back")
    return placed(rows, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
