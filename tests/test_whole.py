"""Queries that do the whole of a job of which an older query does a part."""

import math

import pytest
from pyspark.sql import functions as F

from parcelon.operators import geometry as G
from parcelon.operators import versions as V


def rings(spark, *points):
    """Rings 1, 2, ... of lists of places."""
    return spark.createDataFrame([(r, i, float(x), float(y)) for r, p in enumerate(points, 1) for i, (x, y) in enumerate(p, 1)], "ring long, seq int, x double, y double")


def test_boundary_distance_takes_every_segment(spark):
    s = G.segments(rings(spark, [(0, 0), (1, 0), (1, 3), (0, 3)], [(0, 0), (1, 0), (1, 1), (0, 1)]))
    target = s.where("ring = 2").withColumn("ring", F.lit(1).cast("long"))
    r = G.boundary_distance(s.where("ring = 1"), target, 0.5).first()
    assert (r.ring, r.samples, r.most, r.bound) == (1, 17, 2.0, 2.25)


def test_centroids_of_small_and_flat_rings(spark):
    small = [(139, 35), (139 + 1e-5, 35), (139 + 1e-5, 35 + 1e-5), (139, 35 + 1e-5)]
    found = {r.ring: r for r in G.centroids(G.segments(rings(spark, small, [(139, 35), (140, 36), (141, 37)]))).collect()}
    assert math.isclose(found[1].cx, 139 + 5e-6, abs_tol=1e-11) and math.isclose(found[1].cy, 35 + 5e-6, abs_tol=1e-11)
    assert found[2].cx is None and found[2].cy is None


def test_layers_differ_in_what_sums_and_maxima_hide(spark):
    made = lambda *r: spark.createDataFrame(r, "k long, status string, prio string")
    flags = lambda a, b: {k for k, v in V.compare_layers(a, b, "k").first().asDict().items() if v}
    a = made((1, "O", "2-HIGH"), (4, "F", "5-LOW"))
    every = {"same_schema", "same_count", "same_values", "same_attributes", "same_keys", "same_status", "same_prio"}
    assert flags(a, made((4, "F", "5-LOW"), (1, "O", "2-HIGH"))) == every
    assert flags(a, made((1, "O", "3-MEDIUM"), (4, "F", "5-LOW"))) == every - {"same_values", "same_attributes", "same_prio"}
    assert flags(a, made((2, "O", "2-HIGH"), (3, "F", "5-LOW"))) == every - {"same_values", "same_keys"}
    assert flags(a, a.drop("status")) == {"same_count", "same_keys", "same_prio"}
    assert flags(a.limit(0), a.limit(0)) == every


def test_partners_are_found_whatever_their_number(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    near = [(0.01, 0), (1, 0.01), (1, 1), (0, 1)]
    v = rings(spark, square, [(5, 5), (6, 5), (6, 6)], near, [(0, 0), (1, 1), (0.5, 0.6)])
    found = {(r.ring, r.b_ring): r.d for r in G.alike_rings(v, v, 0.02, 0.1).where("ring < b_ring").collect()}
    assert found == {(1, 3): pytest.approx(0.01)}
    assert (1, 4) in {(r.ring, r.b_ring) for r in G.alike_rings(v, v, 0.02, 2.0).collect()}


def test_a_bow_tie_crosses_itself(spark):
    s = G.segments(rings(spark, [(0, 0), (1, 1), (1, 0), (0, 1)], [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0), (1, 1)]))
    assert [tuple(r) for r in G.self_crossings(s).collect()] == [(1, 1, 3)]
