"""Comparing layers of two GeoPackages: content by fingerprints, and what the files declare."""

from __future__ import annotations

import hashlib
import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.geopackage import quoted
from . import versions as V


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while piece := file.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def declared(path: str, layer: str) -> dict:
    """What a file says of a layer: geometry column and type, reference system, columns, styles. These
    tables hold a few rows whatever the layer's size."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        if db.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
            raise ValueError(f"{path}: the database is damaged")
        meta = db.execute("SELECT column_name, geometry_type_name, srs_id, z, m FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        if meta is None:
            raise ValueError(f"{path}: no layer {layer}")
        columns = sorted(tuple(r[1:]) for r in db.execute(f"PRAGMA table_info({quoted(layer)})"))
        kind = next(c[1].upper() for c in columns if c[0] == meta[0])
        styles = None
        if db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = 'layer_styles'").fetchone():
            styles = sorted(map(repr, db.execute("SELECT * FROM layer_styles")))
        srs = db.execute("SELECT * FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (meta[2],)).fetchone()
    return {"geometry": meta[0], "schema": columns, "declaration": (meta, kind), "srs": srs, "styles": styles}


def selected(rows: DataFrame, field: str | None, value) -> DataFrame:
    """Rows whose field has the value; a field that is not there fails, and so does a selection of
    none (in the count that fingerprints need anyway)."""
    if field is None:
        return rows
    if field not in rows.columns:
        raise ValueError(f"no such field: {field}")
    return rows.where(F.col(f"`{field}`") == value)


def compare_layers(spark: SparkSession, left: str, right: str, layer: str, right_layer: str | None = None, field: str | None = None, value=None) -> dict[str, bool]:
    """The eight same_* flags of two layers, by way of the data source "gpkg"."""
    sides = [(left, layer), (right, right_layer or layer)]
    before = [file_sha256(path) for path, _ in sides]
    says = [declared(*s) for s in sides]
    prints = []
    for (path, name), d in zip(sides, says, strict=True):
        rows = selected(spark.read.format("gpkg").option("layer", name).option("raw", "true").load(path), field, value)
        kinds = {c: t + ":" for c, t in sorted(rows.dtypes)}
        attributes = {c: t for c, t in kinds.items() if c != d["geometry"]}
        full, part = (tuple(V.fingerprint(rows, k).first()) for k in (kinds, attributes))
        if not full[0]:
            raise ValueError(f"{path}: no features match the selection")
        key = next(c[0] for c in d["schema"] if c[4])
        blobs = V.fingerprint(rows, {key: kinds[key], d["geometry"]: kinds[d["geometry"]]}).first()
        prints.append({"columns": sorted(rows.columns), "full": full, "attributes": part, "blobs": tuple(blobs)})
    if before != [file_sha256(path) for path, _ in sides]:
        raise ValueError("a file changed while it was read")
    a, b = prints
    same = lambda what: says[0][what] == says[1][what]
    columns = a["columns"] == b["columns"]
    return {
        "same_file": before[0] == before[1],
        "same_feature_values": columns and a["full"] == b["full"],
        "same_geometry_blobs": a["blobs"] == b["blobs"],
        "same_attributes": columns and a["attributes"] == b["attributes"],
        "same_feature_schema": same("schema"),
        "same_geometry_declaration": same("declaration"),
        "same_srs_definition": same("srs"),
        "same_style_table": same("styles"),
    }
