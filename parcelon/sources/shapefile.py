"""Spark data source "shp": polygon shapefiles.

Options: path (of the .shp; its .shx lies beside it), records (rows a partition), rec (the number of
the only record to read), only ("bounds": no ring is read). The index file gives the place of each
record, so that a partition reads its own range only; both files must lie where every executor can
open them. Columns: rec (from 0), xmin, ymin, xmax, ymax and rings, an array of rings of (x, y), or,
with only=bounds, parts, the number of rings; all but rec are null for a null shape. Shapes other
than polygons fail.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POLYGONS = (5, 15, 25)
MAGIC = 9994
HEAD = 100


def index_path(path: str) -> str:
    return path[:-4] + (".SHX" if path.endswith(".SHP") else ".shx")


def checked(path: str) -> str:
    with open(path, "rb") as file:
        head = file.read(HEAD)
    if len(head) < HEAD or struct.unpack_from(">i", head)[0] != MAGIC:
        raise ValueError(f"{path}: not a shapefile")
    return path


#: Bytes of a record up to its number of rings.
BOUNDS = 40


def shape(content: bytes, bounds: bool = False) -> tuple:
    """Bounds and rings (or their number) of a record's content; nulls for a null shape."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return (None,) * 5
    if kind not in POLYGONS:
        raise ValueError(f"shape type {kind} is no polygon")
    if bounds:
        return struct.unpack_from("<4di", content, 4)
    parts, places = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), places]
    flat = struct.unpack_from(f"<{2 * places}d", content, 44 + 4 * parts)
    rings = [list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2], strict=True)) for a, b in zip(starts, starts[1:], strict=False)]
    return (*struct.unpack_from("<4d", content, 4), rings)


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ShpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.step = int(options.get("records", 20_000))
        self.rec = int(options["rec"]) if "rec" in options else None
        self.bounds = options.get("only") == "bounds"

    def partitions(self) -> list[Span]:
        checked(self.path)
        records = (os.path.getsize(checked(index_path(self.path))) - HEAD) // 8
        if self.rec is not None:
            if not 0 <= self.rec < records:
                raise ValueError(f"{self.path}: no record {self.rec} among {records}")
            return [Span(self.rec, self.rec + 1)]
        return [Span(i, min(i + self.step, records)) for i in range(0, records, self.step)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        with open(index_path(self.path), "rb") as index, open(self.path, "rb") as file:
            index.seek(HEAD + 8 * partition.first)
            for rec in range(partition.first, partition.last):
                offset, words = struct.unpack(">2i", index.read(8))
                file.seek(2 * offset + 8)
                size = min(2 * words, BOUNDS) if self.bounds else 2 * words
                content = file.read(size)
                if len(content) < size:
                    raise ValueError(f"{self.path}: record {rec} is cut off")
                yield (rec, *shape(content, self.bounds))


class ShpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        last = "parts int" if self.options.get("only") == "bounds" else "rings array<array<struct<x: double, y: double>>>"
        return f"rec long, xmin double, ymin double, xmax double, ymax double, {last}"

    def reader(self, schema) -> ShpReader:
        return ShpReader(dict(self.options))
