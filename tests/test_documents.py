import gzip
import hashlib
import json
import sqlite3
import zipfile

import pytest

from parcelon import sources
from parcelon.functions import wkb
from parcelon.sources import documents as D

SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]


def test_wkb_round_trip():
    for polygons in ([[SQUARE, HOLE]], [[SQUARE], [HOLE]], []):
        assert wkb.decode(wkb.encode(polygons)) == polygons
    with pytest.raises(ValueError):
        wkb.decode(wkb.encode([[SQUARE]]) + b"x")
    with pytest.raises(ValueError):
        wkb.decode(b"\x01\x01\x00\x00\x00" + b"\0" * 16)
    with pytest.raises(ValueError):
        wkb.unpack(b"XX" + b"\0" * 8)


@pytest.fixture
def layer(spark, tmp_path):
    sources.register(spark)
    path = tmp_path / "a.gpkg"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('lots', 'geom', 6668)")
    db.execute("CREATE TABLE lots (fid INTEGER PRIMARY KEY, geom BLOB, \"the name\" TEXT, area REAL)")
    blobs = [wkb.pack(6668, wkb.encode([[SQUARE, HOLE]])), wkb.pack(6668, wkb.encode([[SQUARE], [HOLE]])), None]
    db.executemany("INSERT INTO lots VALUES (?, ?, ?, ?)", [(3 * i + 1, b, f"n{i}", i / 2) for i, b in enumerate(blobs)])
    db.commit()
    yield db, str(path)
    db.close()


def test_geopackage_layer(spark, layer):
    df = spark.read.format("gpkg").option("path", layer[1]).option("srs", 6668).option("records", 2).load()
    assert df.columns == ["fid", "the name", "area", "srs_id", "polygons"]
    rows = sorted(df.collect())
    assert [r["fid"] for r in rows] == [1, 4, 7] and [r["the name"] for r in rows] == ["n0", "n1", "n2"]
    shown = [r["polygons"] and [[[tuple(p) for p in ring] for ring in g] for g in r["polygons"]] for r in rows]
    assert shown == [[[SQUARE, HOLE]], [[SQUARE], [HOLE]], None]
    assert rows[2]["srs_id"] is None


def test_geopackage_of_another_reference_or_with_two_layers_fails(spark, layer):
    db, path = layer
    with pytest.raises(Exception, match="has reference"):
        spark.read.format("gpkg").option("path", path).option("srs", 4326).load().collect()
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('other', 'geom', 6668)")
    db.commit()
    with pytest.raises(Exception, match="2 layers"):
        spark.read.format("gpkg").option("path", path).load().collect()


def esri(tmp_path, features, wkid=6668):
    path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps({"spatialReference": {"wkid": wkid}, "features": [{"attributes": {"id": k, "n": 1}, "geometry": {"rings": rings}} for k, rings in features]}))
    return str(path)


def test_esri_features(spark, tmp_path):
    read = lambda p: D.esri_features(spark, p, "id: string, n: int", "id", 6668).collect()
    rows = sorted(read(esri(tmp_path, [("a", [SQUARE]), ("b", [HOLE])])))
    assert [(r["id"], r["n"], [tuple(p) for p in r["ring"]]) for r in rows] == [("a", 1, SQUARE), ("b", 1, HOLE)]
    assert read(esri(tmp_path, [])) == []
    for features, wkid, says in (
        ([("a", [SQUARE])], 4326, "reference"),
        ([("a", [SQUARE]), ("a", [HOLE])], 6668, "repeats"),
        ([(None, [SQUARE])], 6668, "missing"),
        ([("a", [SQUARE, HOLE])], 6668, "one ring"),
        ([("a", [SQUARE[:4]])], 6668, "open"),
        ([("a", None)], 6668, "one ring"),
    ):
        with pytest.raises(Exception, match=says):
            read(esri(tmp_path, features, wkid))


GML = """<Dataset xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink">
{curves}
<gml:Surface gml:id="s1"><gml:patches><gml:PolygonPatch>
<gml:exterior><gml:Ring><gml:curveMember xlink:href="#_c1"/></gml:Ring></gml:exterior>
<gml:interior><gml:Ring><gml:curveMember xlink:href="#c2"/></gml:Ring></gml:interior>
</gml:PolygonPatch></gml:patches></gml:Surface>
<Boundary gml:id="b1"><bounds xlink:href="#s1"/><code>01234</code></Boundary>
</Dataset>"""
CURVE = '<gml:Curve gml:id="{0}"><gml:segments><gml:LineStringSegment><gml:posList>\n{1}\n</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve>'


def test_gml_boundaries(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text(GML.format(curves=CURVE.format("_c1", "35.5 139.5\n36 140\n35.5 139.5") + CURVE.format("c2", "35.1 139.1 35.2 139.2") + CURVE.format("c3", "1 2")))
    rows = D.gml_boundaries(spark, str(path), "Boundary").collect()
    shown = {(r["code"], r["surface"], r["role"], r["curve"]): [tuple(p) for p in r["ring"]] for r in rows}
    assert shown == {("01234", "s1", "exterior", "c1"): [(139.5, 35.5), (140.0, 36.0), (139.5, 35.5)], ("01234", "s1", "interior", "c2"): [(139.1, 35.1), (139.2, 35.2)]}


def test_manifest(spark, tmp_path):
    for name, body in (("a.bin", b"one"), ("b.bin", b"two"), ("empty.bin", b""), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(body)
    found = D.manifest(spark, str(tmp_path), "*.bin")
    assert sorted(map(tuple, found.collect())) == [("a.bin", 3, hashlib.sha256(b"one").hexdigest()), ("b.bin", 3, hashlib.sha256(b"two").hexdigest())]
    wanted = spark.createDataFrame([("a.bin", "0"), ("d.bin", "1")], "name string, sha256 string")
    assert sorted(map(tuple, D.differing(found, wanted).collect())) == [("a.bin", "changed"), ("b.bin", "surplus"), ("d.bin", "missing")]


def test_zip_members(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as file:
        file.writestr("d/a.SHP", b"shape")
        file.writestr("d/a.txt", b"text")
    assert list(map(tuple, D.zip_members(spark, str(path), (".shp",)).collect())) == [("a.zip", "d/a.SHP", 5, hashlib.sha256(b"shape").hexdigest())]
    path.write_bytes(path.read_bytes().replace(b"shape", b"shapf"))
    with pytest.raises(Exception, match="Bad CRC"):
        D.zip_members(spark, str(path)).collect()


def test_gzip_json(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as file:
        file.write('{"blob": "AAE="}')
    assert spark.read.json(str(tmp_path / "a.json.gz")).selectExpr("unbase64(blob) AS b").first()["b"] == b"\x00\x01"
