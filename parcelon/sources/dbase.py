"""Spark data source "dbf": dBASE III tables.

Options: path, encoding (utf-8), deleted ("skip", or "keep" to get them flagged), records (rows a
partition), columns (names to decode, separated by commas; one that the file lacks is left out). Records have one length, so a partition is a range of them and is read by seeking; the
file must lie where every executor can open it. Columns: rec (place in the file, from 0), deleted,
then each field as text without its padding. A truncated file fails.

The writer takes columns in the order of the option fields ("name:bytes,..."; bytes like N4 make a
numeric field, whose text stands to the right); rec and deleted are left out if they are no fields. Tasks write parts beside the target, in a folder that all
executors share, and the commit appends them to one file in the order of the partitions. Text that
does not fit its field fails rather than be cut, and so does a file that is there already, unless
the mode is overwrite.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

_HEADER = struct.Struct("<4xIHH20x")
_FIELD = struct.Struct("<11sc4xB15x")


def layout(path: str) -> tuple[int, int, int, list[tuple[str, int]]]:
    """Records, bytes before them, bytes of each, and the fields with their widths."""
    with open(path, "rb") as file:
        records, start, width = _HEADER.unpack(file.read(_HEADER.size))
        described = file.read(start - _HEADER.size)
    fields, at = [], 0
    while described[at : at + 1] not in (b"\r", b""):
        name, _, size = _FIELD.unpack_from(described, at)
        fields.append((name.split(b"\0")[0].decode("ascii"), size))
        at += _FIELD.size
    if sum(size for _, size in fields) + 1 != width:
        raise ValueError(f"{path}: fields do not add up to the record length")
    return records, start, width, fields


def chosen(options: dict) -> set[str] | None:
    return {n.strip() for n in options["columns"].split(",")} if "columns" in options else None


def field(described: str) -> tuple[str, str, int]:
    """Name, kind and bytes of a field such as CODE:5 or ZONE:N2."""
    name, size = described.rsplit(":", 1)
    size = size.strip()
    return name.strip(), size[0] if size[0] in "CN" else "C", int(size.lstrip("CN"))


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class DbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.encoding = options.get("encoding", "utf-8")
        self.keep = options.get("deleted", "skip") == "keep"
        self.chosen = chosen(options)
        self.step = int(options.get("records", 500_000))

    def partitions(self) -> list[Span]:
        records = layout(self.path)[0]
        return [Span(i, min(i + self.step, records)) for i in range(0, records, self.step)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        _, start, width, fields = layout(self.path)
        with open(self.path, "rb") as file:
            file.seek(start + partition.first * width)
            for rec in range(partition.first, partition.last):
                row = file.read(width)
                if len(row) < width:
                    raise ValueError(f"{self.path}: record {rec} is cut off")
                gone = row[:1] == b"*"
                if gone and not self.keep:
                    continue
                values, at = [], 1
                for name, size in fields:
                    if self.chosen is None or name in self.chosen:
                        values.append(row[at : at + size].decode(self.encoding).strip(" \0"))
                    at += size
                yield (rec, gone, *values)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class DbfWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.encoding = options.get("encoding", "utf-8")
        self.fields = [field(f) for f in options["fields"].split(",")]
        wrong = [name for name, _, size in self.fields if len(name.encode("ascii")) > 10 or not 0 < size < 255]
        if wrong:
            raise ValueError(f"fields that dBASE can't hold: {wrong}")
        if not overwrite and os.path.exists(self.path):
            raise FileExistsError(self.path)
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        os.makedirs(self.parts, exist_ok=True)
        # Each attempt has a file of its own; the commit reads those that succeeded.
        number, rows = TaskContext.get().partitionId(), 0
        path = f"{self.parts}/{number}-{uuid.uuid4().hex}"
        with open(path, "xb") as file:
            for row in iterator:
                file.write(b" ")
                for name, kind, size in self.fields:
                    value = ("" if row[name] is None else str(row[name])).encode(self.encoding)
                    if len(value) > size:
                        raise ValueError(f"{name}: over {size} bytes")
                    file.write(value.rjust(size) if kind == "N" else value.ljust(size))
                rows += 1
        return Part(number, path, rows)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        rows, width = sum(p.rows for p in parts), 1 + sum(size for _, _, size in self.fields)
        whole = f"{self.path}.{uuid.uuid4().hex}"
        with open(whole, "xb") as file:
            file.write(struct.pack("<B3xIHH20x", 3, rows, _HEADER.size + _FIELD.size * len(self.fields) + 1, width))
            for name, kind, size in self.fields:
                file.write(_FIELD.pack(name.encode("ascii"), kind.encode(), size))
            file.write(b"\r")
            for part in parts:
                with open(part.path, "rb") as body:
                    shutil.copyfileobj(body, file, 1 << 20)
            file.write(b"\x1a")
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> StructType:
        fields, wanted = layout(self.options["path"].removeprefix("file://"))[3], chosen(dict(self.options))
        fields = [f for f in fields if wanted is None or f[0] in wanted]
        return StructType([StructField("rec", LongType()), StructField("deleted", BooleanType()), *(StructField(n, StringType()) for n, _ in fields)])

    def reader(self, schema: StructType) -> DbfReader:
        return DbfReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DbfWriter:
        missing = {f.rsplit(":", 1)[0].strip() for f in self.options["fields"].split(",")} - set(schema.names)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        return DbfWriter(dict(self.options), overwrite)
