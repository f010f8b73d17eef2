"""Spark data source "gpkg": a polygon layer of a GeoPackage.

Options: path, layer (may be left out if the file has one only), srs (the id that the layer and
all its geometries must have), records (rows a partition), raw ("true": the geometry column as it
is, instead of srs_id and polygons). A partition is a range of the layer's integer key that holds
so many rows. The file must lie where every executor can open it. Columns: the key and the
attributes of the layer, srs_id, and polygons, an array of polygons of rings of (x, y); both are
null for a null geometry, and polygons is empty for an empty one.

The writer takes attributes and a column polygons; options: path, layer, srs. Tasks write parts
beside the target, in a folder that all executors share; the commit gathers them, in the order of
the partitions, in one file, with the tables that the format asks for. A layer of no rows writes
nothing; a file that is there already fails, unless the mode is overwrite.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import wkb

POLYGONS = "array<array<array<struct<x: double, y: double>>>>"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str):
    return closing(sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True))


def column_type(declared: str) -> str:
    name = declared.upper()
    if "INT" in name:
        return "long"
    if any(k in name for k in ("REAL", "DOUB", "FLOA")):
        return "double"
    if name == "BOOLEAN":
        return "boolean"
    return "binary" if "BLOB" in name else "string"


class Layer:
    """Name, key, geometry column and attributes of the layer that the options name."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.srs = int(options["srs"]) if "srs" in options else None
        with opened(self.path) as db:
            layers = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall()
            if "layer" in options:
                layers = [x for x in layers if x[0] == options["layer"]]
            if len(layers) != 1:
                raise ValueError(f"{self.path}: {len(layers)} layers where one is needed")
            self.name, self.geometry, srs = layers[0]
            if self.srs is not None and srs != self.srs:
                raise ValueError(f"{self.path}: layer {self.name} has reference {srs}, not {self.srs}")
            columns = db.execute(f"PRAGMA table_info({quoted(self.name)})").fetchall()
            keys = [c[1] for c in columns if c[5]]
            if len(keys) != 1:
                raise ValueError(f"{self.path}: layer {self.name} has no single key")
            self.key = keys[0]
            self.attributes = [(c[1], column_type(c[2])) for c in columns if c[1] not in (self.key, self.geometry)]

    def firsts(self, step: int) -> list[int]:
        """Each step-th key, and one beyond the last."""
        with opened(self.path) as db:
            asked = f"SELECT k FROM (SELECT {quoted(self.key)} AS k, row_number() OVER (ORDER BY {quoted(self.key)}) - 1 AS n FROM {quoted(self.name)}) WHERE n % ? = 0 ORDER BY k"
            found = [k for (k,) in db.execute(asked, (step,))]
            return [*found, db.execute(f"SELECT max({quoted(self.key)}) FROM {quoted(self.name)}").fetchone()[0] + 1] if found else []


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GpkgReader(DataSourceReader):
    def __init__(self, options: dict):
        self.layer = Layer(options)
        self.step = int(options.get("records", 20_000))
        self.raw = options.get("raw", "false") == "true"

    def partitions(self) -> list[Span]:
        keys = self.layer.firsts(self.step)
        return [Span(a, b) for a, b in zip(keys, keys[1:], strict=False)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        layer = self.layer
        names = [layer.key, *(n for n, _ in layer.attributes), layer.geometry]
        kinds = [kind for _, kind in layer.attributes]
        asked = f"SELECT {', '.join(map(quoted, names))} FROM {quoted(layer.name)} WHERE {quoted(layer.key)} >= ? AND {quoted(layer.key)} < ? ORDER BY {quoted(layer.key)}"
        with opened(layer.path) as db:
            for key, *values, blob in db.execute(asked, (partition.first, partition.last)):
                values = [bool(v) if kind == "boolean" and v is not None else v for v, kind in zip(values, kinds, strict=True)]
                if self.raw:
                    yield (key, *values, blob)
                    continue
                if blob is None:
                    yield (key, *values, None, None)
                    continue
                srs, empty, body = wkb.unpack(blob)
                if layer.srs is not None and srs != layer.srs:
                    raise ValueError(f"{layer.path}: feature {key} has reference {srs}, not {layer.srs}")
                yield (key, *values, srs, [] if empty else wkb.decode(body))


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


#: The format's application id, version and tables.
CORE = """PRAGMA application_id = 1196444487;
PRAGMA user_version = 10300;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', ''), ('Undefined geographic', 0, 'NONE', 0, 'undefined', '');"""


class GpkgWriter(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.layer, self.srs = options["path"].removeprefix("file://"), options["layer"], int(options.get("srs", 0))
        if not overwrite and os.path.exists(self.path):
            raise FileExistsError(self.path)
        if "polygons" not in schema.names:
            raise ValueError("a layer needs a column polygons")
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
        self.fields = [(f.name, kinds.get(f.dataType.simpleString(), "TEXT")) for f in schema.fields if f.name not in ("polygons", "fid", "geom", "srs_id")]
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def table(self) -> str:
        shown = "".join(f", {quoted(n)} {k}" for n, k in self.fields)
        return f"CREATE TABLE {quoted(self.layer)} (fid INTEGER PRIMARY KEY, geom BLOB{shown})"

    def write(self, iterator: Iterator) -> Part:
        os.makedirs(self.parts, exist_ok=True)
        number, rows, names = TaskContext.get().partitionId(), 0, [n for n, _ in self.fields]
        path = f"{self.parts}/{number}-{uuid.uuid4().hex}"
        with closing(sqlite3.connect(path)) as db, db:
            db.execute(self.table())
            asked = f"INSERT INTO {quoted(self.layer)} VALUES (NULL{', ?' * (1 + len(names))})"
            for row in iterator:
                shape = row["polygons"]
                blob = None if shape is None else wkb.pack(self.srs, wkb.encode([[[(p[0], p[1]) for p in ring] for ring in polygon] for polygon in shape]))
                db.execute(asked, (blob, *(row[n] if row[n] is None or isinstance(row[n], (int, float, str, bytes)) else str(row[n]) for n in names)))
                rows += 1
        return Part(number, path, rows)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        if parts:
            whole = f"{self.path}.{uuid.uuid4().hex}"
            with closing(sqlite3.connect(whole, isolation_level=None)) as db:
                db.executescript(CORE)
                if self.srs > 0:
                    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', '')", (f"EPSG:{self.srs}", self.srs, self.srs))
                db.execute(self.table())
                names = ", ".join(["geom", *(quoted(n) for n, _ in self.fields)])
                for part in parts:
                    db.execute("ATTACH ? AS part", (part.path,))
                    db.execute(f"INSERT INTO {quoted(self.layer)} ({names}) SELECT {names} FROM part.{quoted(self.layer)} ORDER BY fid")
                    db.execute("DETACH part")
                db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, last_change, srs_id) VALUES (?, 'features', ?, '2020-01-01T00:00:00Z', ?)", (self.layer, self.layer, self.srs))
                db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (self.layer, self.srs))
                if db.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
                    raise ValueError(f"{whole}: damaged")
            os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class GpkgSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        layer = Layer(dict(self.options))
        shown = [f"`{n.replace('`', '``')}` {kind}" for n, kind in [(layer.key, "long"), *layer.attributes]]
        if self.options.get("raw", "false") == "true":
            return ", ".join([*shown, f"`{layer.geometry}` binary"])
        return ", ".join([*shown, "srs_id int", f"polygons {POLYGONS}"])

    def reader(self, schema) -> GpkgReader:
        return GpkgReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GpkgWriter:
        return GpkgWriter(dict(self.options), schema, overwrite)
