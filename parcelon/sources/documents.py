"""Feature sets in JSON and GML, and manifests of files: Spark's own readers and joins."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def esri_features(spark: SparkSession, path: str, attributes: str, key: str, wkid: int) -> DataFrame:
    """Features of Esri JSON files: the attributes (a DDL schema) and ring.

    Fails while it runs if the reference is another one, a key is missing or repeats, or a
    geometry is not exactly one closed ring of finite coordinates.
    """
    shape = f"spatialReference struct<wkid: int, latestWkid: int>, features array<struct<attributes: struct<{attributes}>, geometry: struct<rings: array<array<array<double>>>>>>"
    rows = spark.read.json(path, schema=shape, multiLine=True, mode="FAILFAST")
    found = rows.select(F.coalesce("spatialReference.latestWkid", "spatialReference.wkid").alias("srs"), F.explode("features").alias("f"))
    found = found.select("srs", "f.attributes.*", F.col("f.geometry.rings").alias("rings"))
    found = found.withColumn("copies", F.count("*").over(Window.partitionBy(key)))
    ring = F.get("rings", F.lit(0))
    finite = F.forall(ring, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    closed = (F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    wrong = (
        F.when(~F.col("srs").eqNullSafe(F.lit(wkid)), "another spatial reference")
        .when(F.col(key).isNull(), "a key is missing")
        .when(F.col("copies") > 1, "a key repeats")
        .when(~F.coalesce(F.size("rings") == 1, F.lit(False)), "not exactly one ring")
        .when(~F.coalesce(finite & closed, F.lit(False)), "a ring is open or not finite")
    )
    # The check is part of a column that callers read, so it is not pruned away.
    whole = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("feature: "), wrong)).cast("string")).otherwise(F.col(key).cast("string"))
    points = F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    named = [F.when(whole.isNotNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in found.columns if c not in ("srs", "rings", "copies")]
    return found.select(*named, F.when(whole.isNotNull(), points).alias("ring"))


def href(column: str) -> Column:
    """The id that a reference points to."""
    return F.regexp_replace(column, "^[#_]+", "")


def gml_boundaries(spark: SparkSession, path: str, tag: str, bounds: str = "bounds", code: str = "code", prefix: str = "gml:") -> DataFrame:
    """Boundary features of a GML file with their curves: code, surface, role, curve, ring.

    Three scans by row tag and two equi-joins by reference; latitude comes first in the file, and
    the ring is (x: longitude, y: latitude). A reference that leads nowhere gives no row.
    """

    def rows(name: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", name).schema(schema).load(path)

    curve_schema = f"`_gml:id` string, `{prefix}segments` struct<`{prefix}LineStringSegment`: struct<`{prefix}posList`: string>>"
    curves = rows(f"{prefix}Curve", curve_schema).select(href("`_gml:id`").alias("curve"), F.col(f"`{prefix}segments`.`{prefix}LineStringSegment`.`{prefix}posList`").alias("places"))
    numbers = F.transform(F.split(F.trim("places"), r"\s+"), lambda v: v.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(F.get(numbers, 2 * i + 1).alias("x"), F.get(numbers, 2 * i).alias("y")))
    curves = curves.where("places IS NOT NULL").select("curve", pairs.alias("ring"))

    member = f"struct<`{prefix}Ring`: struct<`{prefix}curveMember`: array<struct<`_xlink:href`: string>>>>"
    patch = f"`{prefix}patches` struct<`{prefix}PolygonPatch`: struct<`{prefix}exterior`: {member}, `{prefix}interior`: array<{member}>>>"
    surfaces = rows(f"{prefix}Surface", f"`_gml:id` string, {patch}")
    body = f"`{prefix}patches`.`{prefix}PolygonPatch`"
    refs = lambda m: F.transform(m[f"{prefix}Ring"][f"{prefix}curveMember"], lambda c: c["_xlink:href"])
    listed = lambda role, hrefs: F.transform(hrefs, lambda h: F.struct(F.lit(role).alias("role"), h.alias("h")))
    none = F.array().cast("array<string>")
    outer = F.coalesce(refs(F.col(f"{body}.`{prefix}exterior`")), none)
    inner = F.flatten(F.coalesce(F.transform(F.col(f"{body}.`{prefix}interior`"), refs), F.array().cast("array<array<string>>")))
    surfaces = surfaces.select(href("`_gml:id`").alias("surface"), F.explode(F.concat(listed("exterior", outer), listed("interior", inner))).alias("m"))
    surfaces = surfaces.select("surface", F.col("m.role").alias("role"), href("m.h").alias("curve"))

    features = rows(tag, f"`{bounds}` struct<`_xlink:href`: string>, `{code}` string").select(href(f"`{bounds}`.`_xlink:href`").alias("surface"), F.col(f"`{code}`").alias("code"))
    return features.join(surfaces, "surface").join(curves, "curve").select("code", "surface", "role", "curve", "ring")


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: name, bytes, sha256.

    Spark's reader of binary files gives no row for an empty file, and can't read one over 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differing(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names whose entry in two manifests differs: name, what (missing, surplus, changed)."""
    a, b = found.select("name", F.col("sha256").alias("a")), wanted.select("name", F.col("sha256").alias("b"))
    what = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "surplus").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "name", "full_outer").select("name", what.alias("what")).where("what IS NOT NULL")


def zip_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Members of ZIP archives: archive, member, bytes, sha256. A member that is damaged fails.

    Members are hashed in pieces, and only the archive itself is held in memory.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as file:
                    for info in file.infolist():
                        if info.is_dir() or suffixes and not info.filename.lower().endswith(suffixes):
                            continue
                        digest = hashlib.sha256()
                        with file.open(info) as member:  # its checksum is tested at the end
                            while piece := member.read(1 << 20):
                                digest.update(piece)
                        rows.append((archive.rsplit("/", 1)[-1], info.filename, info.file_size, digest.hexdigest()))
                yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "archive string, member string, bytes long, sha256 string")
