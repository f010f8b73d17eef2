import csv
import glob
import json
import math
import random
import sqlite3
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from parcelon import sinks, sources
from parcelon.operators import build as B
from parcelon.operators import geometry as G
from parcelon.operators import layers
from parcelon.operators import overlay as O
from parcelon.operators import rules as R
from parcelon.operators import versions as V
from parcelon.sources import tables

from .test_sources import dbf

NAMES = {"prefecture": "N1", "subprefecture": "N2", "county": "N3", "municipality": "N4", "code": "N7"}
#: Rules for the places below, closed bounds in degrees.
RULES = """rule_id,zone,prefecture,subprefecture,county,municipality,code,lon_min,lon_max,lat_min,lat_max,basis,note
1,1,Kagoshima,,Oshima,,,128.3,130.2166666667,27,32,,
2,1,Kagoshima,,,,,128.3,130,27,32,,
3,2,Kagoshima,,,,,,,,,,
4,2,Fukuoka,,,,,,,,,,
5,11,Hokkaido,,,Tomari,01403,,,,,,
6,13,Hokkaido,,,Tomari,01696,,,,,,
7,18,Tokyo,,,,,,140.5,,28,,
8,14,Tokyo,,,,,140.5,143,,28,,
9,19,Tokyo,,,,,143,,,28,,
10,9,Tokyo,,,,,,,,,,
11,16,Okinawa,,,,,,126,,,,
12,15,Okinawa,,,,,126,130,,,,
13,17,Okinawa,,,,,130,,,,,
"""
ZONES = "zone,zone_roman,epsg_jgd2011\n" + "".join(f"{i},{r},{6668 + i}\n" for i, r in ((1, "I"), (2, "II"), (9, "IX"), (11, "XI"), (13, "XIII"), (14, "XIV"), (19, "XIX")))
PLACES = [("Hokkaido", "", "Tomari", "", "01403", (140.4, 43.0, 140.5, 43.1)), ("Hokkaido", "", "Tomari", "", "01696", (145.5, 43.9, 145.6, 44.0)), ("Tokyo", "", "Ogasawara", "", "13421", (142.1, 27.0, 142.3, 27.1)), ("Tokyo", "", "Ogasawara", "", "13421", (153.9, 24.2, 154.0, 24.3)), ("Kagoshima", "", "Kagoshima", "", "46201", (130.4, 31.5, 130.6, 31.7)), ("Fukuoka", "", "Fukuoka", "East", "40131", (130.4, 33.6, 130.5, 33.7))]
SPLIT = ["Hokkaido", "Tokyo", "Kagoshima", "Okinawa"]
COLUMNS = {"prefecture": "N1", "municipality": "N4", "ward": "N5", "code": "N7"}


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "rules.csv"
    path.write_text("\ufeff" + RULES, encoding="utf-8")
    return tables.load_rules(spark, str(path))


def records(spark, places):
    rows = [(i, False, p, c, m, w, code, *(box or [None] * 4)) for i, (p, c, m, w, code, box) in enumerate(places)]
    found = spark.createDataFrame(rows, "rec long, deleted boolean, N1 string, N3 string, N4 string, N5 string, N7 string, xmin double, ymin double, xmax double, ymax double")
    return B.to_attributes(found, NAMES)


def test_rules_from_csv(rules):
    assert [r["rule_id"] for r in rules] == list(range(1, 14)) and rules[0]["lon_max"] == 130.2166666667 and rules[2]["lat_min"] is None and rules[4]["code"] == "01403"


def test_build_from_end_to_end(spark, rules, tmp_path):
    rows = B.assign_zones(records(spark, PLACES), rules)
    (tmp_path / "zones.csv").write_text(ZONES, encoding="utf-8")
    made = B.enriched(rows, tables.read_zones(spark, str(tmp_path / "zones.csv")), SPLIT, COLUMNS).orderBy("rec").collect()
    assert [r.ZONE for r in made] == ["11", "13", "14", "19", "2", "2"] and [r.EPSG for r in made] == ["6679", "6681", "6682", "6687", "6670", "6670"]
    assert [r.UNIT_CODE for r in made] == ["01403", "01696", "13421", "13421", "46201", "40000"] and [r.UNIT_NAME for r in made] == ["Tomari", "Tomari", "Ogasawara", "Ogasawara", "Kagoshima", "Fukuoka"]
    table = B.key_table(rows, "N7", ["N1", "N4", "N5"])
    assert {r.N7: r.zones for r in table.collect()} == {"01403": "11", "01696": "13", "13421": "14;19", "46201": "2", "40131": "2"}
    said = {r["item"]: r["value"] for r in B.summary(rows, table, COLUMNS, SPLIT).collect()}
    assert (said["polygons"], said["codes"], said["split codes"], said["zone 2"]) == (6, 5, 1, 2)
    assert [said[f"dissolved by {n}"] for n in ("zone", "unit", "municipality")] == [5, 6, 6]
    with pytest.raises(ValueError, match="level"):
        B.dissolve_keys(rows, "ward", COLUMNS, SPLIT)


def test_build_writes_numeric_fields(spark, rules, tmp_path):
    sources.register(spark)
    rows = B.assign_zones(records(spark, PLACES), rules)
    zones = spark.createDataFrame([(i, "X", str(6668 + i)) for i in range(1, 20)], "zone int, zone_roman string, epsg string")
    made = B.enriched(rows, zones, SPLIT, COLUMNS).repartitionByRange(2, "rec").sortWithinPartitions("rec")
    fields = "N1:20,N4:40," + ",".join(f"{n}:{k}" for n, k in B.ADDED.items())
    made.write.format("dbf").options(path=f"{tmp_path}/out.dbf", fields=fields).mode("append").save()
    raw = (tmp_path / "out.dbf").read_bytes()
    kinds = {raw[32 + 32 * i :][:11].split(b"\0")[0].decode(): chr(raw[32 + 32 * i + 11]) for i in range(7)}
    assert kinds["ZONE"] == kinds["EPSG"] == "N" and kinds["UNIT_NAME"] == "C" and b"Fukuoka" in raw and b" 2X " in raw
    back = spark.read.format("dbf").option("columns", "ZONE,EPSG,NOT_THERE").load(f"{tmp_path}/out.dbf").orderBy("rec")
    assert back.columns == ["rec", "deleted", "ZONE", "EPSG"] and [r.ZONE for r in back.collect()] == ["11", "13", "14", "19", "2", "2"]


def test_build_fails_fast(spark, rules):
    cases = [("needs a box", ("Tokyo", "", "x", "", "13421", None)), ("cross into another zone: 9 14", ("Tokyo", "", "x", "", "13421", (142.0, 27.9, 142.1, 28.1))), ("has no rule", ("Nowhere", "", "x", "", "1", (1.0, 1.0, 2.0, 2.0)))]
    for match, place in cases:
        with pytest.raises(Exception, match=match):
            B.assign_zones(records(spark, [PLACES[0], place]), rules).collect()
    boxless = [(*p[:5], None) for p in PLACES[:2]]  # decided by attributes: no box is needed
    assert [r.zone for r in B.assign_zones(records(spark, boxless), rules).orderBy("rec").collect()] == [11, 13]
    gone = records(spark, PLACES).withColumn("deleted", F.col("rec") == 0)
    assert [r.zone for r in B.assign_zones(gone, rules).orderBy("rec").collect()] == [None, 13, 14, 19, 2, 2]
    two = B.assign_zones(records(spark, [PLACES[4], ("Kagoshima", "", "Other", "", "46201", PLACES[4][5])]), rules)
    with pytest.raises(Exception, match="two names"):
        B.key_table(two, "N7", ["N1", "N4"]).collect()


def test_lines_that_cut_boxes(spark, rules):
    boxes = [("Tokyo", "", "a", "", "13421", (142.0, 27.9, 142.1, 28.1)), ("Okinawa", "Shimajiri", "b", "", "47361", (125.9, 26.3, 126.1, 26.4)), ("Kagoshima", "Oshima", "c", "", "46529", (129.9, 28.25, 130.05, 28.35)), ("Tokyo", "", "d", "", "13101", (139.7, 35.6, 139.8, 35.7))]
    got = B.box_report(records(spark, boxes), rules, "rec").orderBy("rec").collect()
    assert [r.zones for r in got] == [[9, 14], [15, 16], [1], [9]] and [r.lines for r in got][:2] == [["lat=28"], ["lon=126"]]


def test_rules_by_case_and_by_join(spark, rules):
    shape = "id int, prefecture string, subprefecture string, county string, municipality string, code string, lon double, lat double"
    rows = [(1, "Tokyo", "", "", "", "", 142.0, 28.0), (2, "Tokyo", None, None, None, None, 143.0, 25.0), (3, "Fukuoka", "", "", "", None, None, None), (4, "Nowhere", "", "", "", "", 1.0, 1.0), (4, "Okinawa", "", "", "", "", 126.0, 1.0), (5, "Hokkaido", "", "", "Tomari", "01696", None, None)]
    frame = spark.createDataFrame([tuple(r.get(c) for c in ["rule_id", "zone", *R.ATTRIBUTES, "code", *R.BOUNDS]) for r in rules], "rule_id int, zone int, prefecture string, subprefecture string, county string, municipality string, code string, lon_min double, lon_max double, lat_min double, lat_max double")
    want = [(1, 14), (2, 14), (3, 2), (4, None), (4, 16), (5, 13)]
    found = spark.createDataFrame(rows, shape)
    show = lambda df: sorted(((r.id, r.zone) for r in df.collect()), key=str)
    assert show(R.classify(found, rules).select("id", "zone")) == show(R.classify_join(found, frame, "id")) == sorted(want, key=str)
    for match, row in (("needs a point", (1, "Tokyo", "", "", "", "", None, 1.0)), ("needs a code", (1, "Hokkaido", "", "", "Tomari", None, 1.0, 1.0)), ("needs a code", (1, "Hokkaido", "", "", "Tomari", "", 1.0, 1.0))):
        one = spark.createDataFrame([row], shape)
        for run in (lambda o: R.classify(o, rules), lambda o: R.classify_join(o, frame, "id")):
            with pytest.raises(Exception, match=match):
                run(one).collect()


def test_long_rule_tables_join_by_an_attribute(spark, rules, monkeypatch):
    frame = spark.createDataFrame([tuple(r.get(c) for c in ["rule_id", "zone", *R.ATTRIBUTES, "code", *R.BOUNDS]) for r in rules], "rule_id int, zone int, prefecture string, subprefecture string, county string, municipality string, code string, lon_min double, lon_max double, lat_min double, lat_max double")
    found = R.classify(records(spark, PLACES).withColumn("lon", F.col("xmin")).withColumn("lat", F.col("ymin")), rules)
    monkeypatch.setattr(R, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, R.classify_join(found.drop("zone"), frame, "rec").collect())) == sorted((r.rec, r.zone) for r in found.collect())


def test_input_errors(tmp_path):
    (tmp_path / "a.shp").write_bytes(b"")
    assert "a.shp" in tables.input_error(str(tmp_path / "a.dbf")) and "table" in tables.input_error(str(tmp_path / "a.shp"))
    assert "no such" in tables.input_error(str(tmp_path / "b.shp")) and "not a" in tables.input_error("x.txt")
    (tmp_path / "a.dbf").write_bytes(b"")
    assert tables.input_error(str(tmp_path / "a.shp")) is None


# -- overlay -----------------------------------------------------------------------------------


def ring(*points):
    return [(*p, *q) for p, q in zip(points, [*points[1:], points[0]])]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x0, y1), (x1, y1), (x1, y0))


def segments(spark, polygons, name="id"):
    return spark.createDataFrame([(k, *map(float, s)) for k, edges in polygons for s in edges], f"{name} string, x0 double, y0 double, x1 double, y1 double")


def overlaid(spark, a, b, **options):
    rows = [("k", s, *map(float, e)) for s, edges in (("a", a), ("b", b)) for e in edges]
    r = O.overlay(spark.createDataFrame(rows, "key string, side string, x0 double, y0 double, x1 double, y1 double"), **options).first()
    return r.a_only, r.b_only, r.both


def test_overlay_of_known_shapes(spark):
    near = lambda got, want: all(abs(g - w) < 1e-9 for g, w in zip(got, want))
    assert near(overlaid(spark, box(0, 0, 2, 2), box(1, 1, 3, 3)), (3, 3, 1))
    assert near(overlaid(spark, box(0, 0, 1, 1), box(1, 0, 2, 1)), (1, 1, 0))  # a shared edge
    square = ring((0, 0), (0, 1), (0, 2), (2, 2), (2, 0))  # one vertex more, on an edge
    assert near(overlaid(spark, square, box(0, 0, 2, 2)), (0, 0, 4))
    holed = box(0, 0, 4, 4) + ring((1, 1), (3, 1), (3, 3), (1, 3))  # the hole runs against its shell
    assert near(overlaid(spark, holed, box(0, 0, 2, 4)), (6, 2, 6)) and near(overlaid(spark, holed, box(0, 0, 2, 4), rule="parity"), (6, 2, 6))
    assert near(overlaid(spark, box(0, 0, 2, 2) + box(1, 0, 3, 2), box(0, 0, 3, 2)), (0, 0, 6))  # two that overlap count once


def test_overlay_of_stars_by_sampling(spark):
    r = random.Random(4)

    def star(cx, cy, n):
        return ring(*((cx + d * math.cos(2 * math.pi * i / n), cy - d * math.sin(2 * math.pi * i / n)) for i in range(n) for d in [r.uniform(0.5, 3)]))

    a, b = star(0, 0, 60), star(0.7, 0.4, 90)
    inside = lambda edges, x, y: sum((y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for x0, y0, x1, y1 in edges) % 2
    count = [0, 0, 0, 0]
    for _ in range(20000):
        x, y = r.uniform(-4, 4), r.uniform(-4, 4)
        count[inside(a, x, y) + 2 * inside(b, x, y)] += 1
    got = overlaid(spark, a, b, band_segments=8)
    assert all(abs(g - 64 * n / 20000) < 0.35 for g, n in zip(got, count[1:]))
    whole = overlaid(spark, a, b, band_segments=10000)
    assert all(abs(g - w) < 1e-9 for g, w in zip(got, whole))


def test_pairs_that_overlap(spark):
    polygons = segments(spark, [("p", box(0, 0, 2, 2)), ("q", box(2, 0, 4, 2)), ("r", box(1, 0, 3, 2)), ("s", box(9, 9, 10, 10))])
    assert sorted((r.a, r.b, round(r.area, 9)) for r in O.self_overlaps(polygons, 1.0).collect()) == [("p", "r", 2.0), ("q", "r", 2.0)]


def zoned(spark, polygons):
    return spark.createDataFrame([(k, z, *map(float, s)) for k, z, edges in polygons for s in edges], "id string, zone int, x0 double, y0 double, x1 double, y1 double")


def test_voids(spark):
    holes = segments(spark, [("both", box(0, 0, 1, 1)), ("none", box(10, 0, 11, 1)), ("filled", box(20, 0, 21, 1)), ("edge", box(30, 0, 31, 1))])
    frame = lambda z, x: (f"f{z}{x}", z, ring((x - 1, -1), (x - 1, 2), (x, 2), (x, -1)))
    published = zoned(spark, [("p", 1, box(20, 0, 21, 1))])
    source = zoned(spark, [("s0", 1, box(-1, -1, 2, 2)), frame(1, 10), frame(1, 20), frame(1, 30), ("s3", 2, box(31, -1, 32, 2))])
    municipal = zoned(spark, [("m0", 1, box(-1, -1, 2, 2)), frame(1, 10), frame(1, 20), frame(1, 30)])
    got = {r.id: (r.cause, r.context, r.decision) for r in O.classify_voids(holes, published, source, municipal, 1.0).collect()}
    assert got == {"both": ("processing", "inside one zone", "confirm"), "none": ("source", "inside one zone", "confirm"), "filled": ("undetermined", "inside one zone", "keep"), "edge": ("source", "between zones", "keep")}


# -- quantiles, fingerprints, files --------------------------------------------------------------


@pytest.mark.parametrize("values", [[5.0], [1.0] * 9, [1.0, 2.0], [float(i % 7) for i in range(100)], [1e9, *map(float, range(50))]])
def test_exact_quantiles(spark, values):
    frame, shares = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), [0.0, 0.25, 0.5, 0.9, 1.0]
    want = frame.agg(F.expr(f"percentile(v, array({', '.join(map(str, shares))}))")).first()[0]
    got = {r.share: r.value for r in G.exact_quantiles(frame, "v", shares, bins=8).collect()}
    assert all(abs(got[s] - w) < 1e-9 for s, w in zip(shares, want))


def test_fingerprint_of_any_size(spark):
    rows = spark.range(4000).selectExpr("id % 1500 AS k")
    prints = [V.fingerprint_table(rows, {"k": "i"}, n).first() for n in (100_000, 300)]
    assert prints[0].n_rows == prints[1].n_rows == 4000
    other = spark.range(4000).selectExpr("if(id = 7, 8, id % 1500) AS k")
    assert all(V.fingerprint_table(other, {"k": "i"}, n).first().sha != p.sha for n, p in zip((100_000, 300), prints))


def package(path, geometry=b"original", label="a", style="old"):
    with closing(sqlite3.connect(path)) as db, db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER, definition TEXT)")
        db.execute("CREATE TABLE zones (fid INTEGER PRIMARY KEY, geom POLYGON, label TEXT)")
        db.execute("CREATE TABLE layer_styles (id INTEGER, style TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('zones', 'geom', 'POLYGON', 6668, 0, 0)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (6668, 'wkt')")
        db.executemany("INSERT INTO zones VALUES (?, ?, ?)", [(1, geometry, label), (2_000_000_000, b"other", "b")])
        db.execute("INSERT INTO layer_styles VALUES (1, ?)", (style,))
    return str(path)


def test_layer_flags(spark, tmp_path):
    sources.register(spark)
    left = package(tmp_path / "a.gpkg")
    wrong = lambda name, **o: {k for k, v in layers.compare_layers(spark, left, package(tmp_path / name, **o), "zones").items() if not v}
    assert wrong("same.gpkg") == set()
    assert wrong("style.gpkg", style="new") == {"same_file", "same_style_table"}
    assert wrong("shape.gpkg", geometry=b"changed") == {"same_file", "same_feature_values", "same_geometry_blobs"}
    assert wrong("label.gpkg", label="c") == {"same_file", "same_feature_values", "same_attributes"}
    other = package(tmp_path / "sel.gpkg", geometry=b"changed")
    assert layers.compare_layers(spark, left, other, "zones", field="label", value="b")["same_feature_values"]
    with pytest.raises(ValueError, match="no features"):
        layers.compare_layers(spark, left, other, "zones", field="label", value="zzz")
    with pytest.raises(ValueError, match="no such field"):
        layers.compare_layers(spark, left, other, "zones", field="nothing", value=1)


def test_packages_and_geojson_are_written(spark, tmp_path):
    sources.register(spark)
    shape = [[[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]]]
    rows = spark.createDataFrame([(f"k{i}", i / 2, shape if i else None) for i in range(7)], "key string, area_m2 double, polygons array<array<array<struct<x: double, y: double>>>>").repartitionByRange(3, "key").sortWithinPartitions("key")
    rows.write.format("gpkg").options(path=f"{tmp_path}/a.gpkg", layer="diff", srs=6668).mode("append").save()
    back = spark.read.format("gpkg").option("srs", 6668).option("records", 2).load(f"{tmp_path}/a.gpkg").orderBy("fid").collect()
    assert [(r.key, r.area_m2) for r in back] == [(f"k{i}", i / 2) for i in range(7)] and back[0].polygons is None and [tuple(p) for p in back[1].polygons[0][0]] == shape[0][0]
    with pytest.raises(Exception, match="FileExistsError|exists"):
        rows.write.format("gpkg").options(path=f"{tmp_path}/a.gpkg", layer="diff").mode("append").save()
    rows.where("false").write.format("gpkg").options(path=f"{tmp_path}/none.gpkg", layer="diff").mode("append").save()
    assert not (tmp_path / "none.gpkg").exists()
    sinks.write_geojson(rows, f"{tmp_path}/a.geojson", ["key", "area_m2"], order=["key"])
    (part,) = glob.glob(f"{tmp_path}/a.geojson/part-*")
    found = json.load(open(part))
    assert found["type"] == "FeatureCollection" and [f["properties"]["key"] for f in found["features"]] == [f"k{i}" for i in range(7)]
    assert found["features"][0]["geometry"] is None and found["features"][1]["geometry"]["coordinates"] == [[[list(p) for p in shape[0][0]]]]


def test_audit_bundle_and_union_tables(spark, tmp_path):
    sources.register(spark)
    comparison = spark.createDataFrame([("z", "2", 0.5, True), ("z", "1", None, False)], "stage string, key string, lost_m2 double, lost_empty boolean")
    holes = spark.createDataFrame([("z", "1", 3)], "stage string, key string, n int")
    differences = spark.createDataFrame([("z", "1", "lost", 0.5, [[[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]]])], "stage string, key string, direction string, area_m2 double, polygons array<array<array<struct<x: double, y: double>>>>")
    sinks.write_audit(f"file://{tmp_path}/out", comparison, holes, spark.createDataFrame([(2,)], "n int"), differences)
    (part,) = glob.glob(f"{tmp_path}/out/comparison.csv/part-*")
    assert list(csv.reader(open(part))) == [["key", "lost_empty", "lost_m2", "stage"], ["1", "false", "", "z"], ["2", "true", "0.5", "z"]]
    assert spark.read.format("gpkg").load(f"{tmp_path}/out/differences.gpkg").count() == 1
    with pytest.raises(Exception, match="exists|EXISTS"):
        sinks.write_table(holes, f"file://{tmp_path}/out/comparison.csv", ["key"], [])
    sinks.write_union([holes, comparison], f"file://{tmp_path}/union.csv", ["key"])
    (part,) = glob.glob(f"{tmp_path}/union.csv/part-*")
    assert next(csv.reader(open(part))) == ["key", "lost_empty", "lost_m2", "n", "stage"]


def test_runs_are_taken_up_again(spark, tmp_path):
    path, seen = f"file://{tmp_path}/done", []

    def work(inputs):
        rows = inputs.collect()
        seen.append(sorted(r.key for r in rows))
        return spark.createDataFrame([(r.key, r.v * 2) for r in rows], "key string, twice int")

    inputs = lambda *rows: spark.createDataFrame([(k, v, f"sha-{v}") for k, v in rows], "key string, v int, input_sha string")
    show = lambda df: sorted((r.key, r.twice) for r in df.collect())
    assert show(sinks.resumed(spark, inputs(("a", 1), ("b", 2)), "key", work, path)) == [("a", 2), ("b", 4)]
    assert show(sinks.resumed(spark, inputs(("a", 1), ("b", 5), ("c", 3)), "key", work, path)) == [("a", 2), ("b", 10), ("c", 6)]
    assert show(sinks.resumed(spark, inputs(("a", 1)), "key", work, path)) == [("a", 2)] and seen == [["a", "b"], ["b", "c"]]


def test_numeric_dbf_columns(spark, tmp_path):
    sources.register(spark)
    dbf(tmp_path / "a.dbf", ["N1", "CODE"], [(" ", ["x", "1"])])
    assert spark.read.format("dbf").option("columns", "CODE").load(str(tmp_path / "a.dbf")).collect()[0].CODE == "1"


def test_a_rule_table_too_long_for_a_chain(spark, tmp_path):
    (tmp_path / "many.csv").write_text(RULES, encoding="utf-8")
    with pytest.raises(ValueError, match="classify_join"):
        tables.load_rules(spark, str(tmp_path / "many.csv"), most=2)
