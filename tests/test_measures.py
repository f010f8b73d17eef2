"""Measures of a published ring, signatures, bytes of scalars, snapshots and copies by type."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from parcelon import sinks
from parcelon.functions import scalars as S
from parcelon.operators import geometry as G
from parcelon.operators import rings as R

#: A published ring in degrees, and what was published about it.
RING = [
    (141.800724527, 40.289185144), (141.800736316, 40.289186757), (141.800740999, 40.289193829), (141.800736576, 40.289204586),
    (141.800712594, 40.28923064), (141.800705707, 40.289242225), (141.800705759, 40.289245829), (141.800703541, 40.289246748),
    (141.800697665, 40.289247694), (141.800682607, 40.289246919), (141.800670986, 40.28924882), (141.800658262, 40.289255135),
    (141.800649118, 40.289265937), (141.800645603, 40.289266865), (141.800627095, 40.289271523), (141.800610947, 40.289277874),
    (141.800605045, 40.289276117), (141.800599196, 40.289269955), (141.800597912, 40.289262847), (141.800607951, 40.289240523),
    (141.800613645, 40.289227955), (141.800646783, 40.28919291), (141.80064677, 40.289192099), (141.800653709, 40.289191955),
    (141.800661868, 40.289194586), (141.800672503, 40.28919891), (141.800681816, 40.28919973), (141.800692257, 40.289197847),
    (141.800713048, 40.289187856), (141.800724527, 40.289185144),
]
SIGNATURE, AREA, PERIMETER, SIDES = "bfb40440ce6f5ac1", 64.55677117730556, 36.11748060741831, (14.487966, 7.530981)
POINTS = "ring long, points array<struct<x:double,y:double>>"


def vertices(spark, rings):
    rows = [(n, i, x, y) for n, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "ring long, seq int, x double, y double")


def test_measures_of_a_published_ring(spark):
    found = R.local_measures(vertices(spark, [RING, [(1.0, 1.0), (1.001, 1.0), (1.0, 1.0)]])).orderBy("ring").collect()
    assert found[0]["area"] == pytest.approx(AREA, rel=1e-6)
    assert found[0]["perimeter"] == pytest.approx(PERIMETER, rel=1e-6)
    assert (found[0]["length"], found[0]["width"]) == pytest.approx(SIDES, rel=1e-6)
    assert found[0]["aspect"] == pytest.approx(SIDES[0] / SIDES[1], rel=1e-6)
    assert found[1]["area"] == 0 and found[1]["aspect"] is None


def test_signature_is_free_of_start_and_direction(spark):
    ring = RING[:-1]
    turned = [RING, ring, ring[::-1], ring[11:] + ring[:11], [*ring[5:], *ring[:6]]]
    rows = [(i, r) for i, r in enumerate(turned)] + [(9, None), (10, []), (11, [(1.0, 2.0)]), (12, [*ring[:-1], (0.0, 0.0)])]
    found = {r["ring"]: r["s"] for r in spark.createDataFrame(rows, POINTS).select("ring", R.wkb_signature("points").alias("s")).collect()}
    assert {found[i][:16] for i in range(5)} == {SIGNATURE}
    assert found[9] is None and found[10] is None and found[11] != found[12] != found[0]


def test_area_of_the_cylinder(spark):
    # A whole turn between two parallels, as the closed form of the zone of an ellipsoid has it.
    f = G.WGS84_FLATTENING
    e2 = f * (2 - f)
    band = [(0.0, 0.0), (90.0, 0.0), (90.0, 90.0), (0.0, 90.0)]
    found = G.segments(vertices(spark, [band])).groupBy("ring").agg(G.wgs84_area().alias("a")).first()["a"]
    e = e2**0.5
    octant = math.pi / 4 * G.AXIS**2 * (1 + (1 - e2) * math.atanh(e) / e)
    assert found == pytest.approx(octant, rel=1e-12)


def test_bytes_of_scalars(spark):
    values = [0.0, -0.0, 1.5, -2.25, 1e-310, 1.7976931348623157e308, float("inf"), None]
    rows = spark.createDataFrame([(i, v, "é" * i) for i, v in enumerate(values)], "i int, v double, t string").orderBy("i")
    found = rows.select("t", S.double_bytes(F.col("v")).alias("v"), S.length_bytes(F.col("t")).alias("n")).collect()
    assert [r["v"] and bytes(r["v"]) for r in found] == [v if v is None else struct.pack(">d", v) for v in values]
    assert [bytes(r["n"]) for r in found] == [struct.pack(">Q", len(r["t"].encode())) for r in found]


def test_snapshot_is_restored_or_fails(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    folder = str(tmp_path / "shot")
    sinks.snapshot(rows, folder)
    assert sorted(map(str, sinks.restored(spark, folder).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.snapshot(rows, folder)
    rows.limit(1).write.mode("append").parquet(f"{folder}/rows")
    with pytest.raises(ValueError, match="differ"):
        sinks.restored(spark, folder)
    sinks.snapshot(rows.where("false"), str(tmp_path / "none"))
    assert sinks.restored(spark, str(tmp_path / "none")).count() == 0


def test_copy_by_type(spark, tmp_path):
    rows = spark.createDataFrame([(1, "07"), (2, "07"), (3, "x y"), (4, None)], "k int, kind string")
    found = sinks.typed_copy(rows, "kind", str(tmp_path / "copy"))
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(ValueError, match="differs"):
        sinks.typed_copy(spark.createDataFrame([(1, "")], "k int, kind string"), "kind", str(tmp_path / "blank"))
