"""Grid joins against brute force, where boxes are wide, tiny, without extent or very dense."""

import random

import pytest

from parcelon.operators import geometry as G

BOX = "id long, xmin double, ymin double, xmax double, ymax double"


def many_boxes(seed, n):
    made = random.Random(seed)
    rows = []
    for i in range(n):
        wide, high = (made.choice((0.0, 1e-7, 0.003, 0.2, 1.0, 40.0, 900.0)) for _ in "xy")
        x, y = (made.uniform(-3, 3), made.uniform(-3, 3)) if i % 3 else (made.uniform(0, 0.01), made.uniform(0, 0.01))
        rows.append((i, x, y, x + wide, y + high))
    return [*rows, (n, 1.0, 1.0, 2.0, 2.0), (n + 1, 2.0, 2.0, 4.0, 4.0), (n + 2, 2.0, 2.0, 2.0, 2.0), (n + 3, None, 0.0, 1.0, 1.0)]


def meeting(a, b):
    whole = lambda r: None not in r
    return sorted((p[0], q[0]) for p in filter(whole, a) for q in filter(whole, b) if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


@pytest.mark.parametrize("size", [0.05, 1.0])
def test_box_join_finds_each_pair_once(spark, size):
    a, b = many_boxes(1, 150), many_boxes(2, 120)
    left = spark.createDataFrame(a, BOX)
    right = spark.createDataFrame(b, BOX).toDF("b_id", "b_xmin", "b_ymin", "b_xmax", "b_ymax")
    assert sorted((r["id"], r["b_id"]) for r in G.box_join(left, right, size).collect()) == meeting(a, b)
    assert G.box_join(left.where("false"), right, size).count() == 0
    own = left.toDF(*right.columns)
    assert sorted((r["id"], r["b_id"]) for r in G.box_join(left, own, size, same=True).collect()) == [(p, q) for p, q in meeting(a, a) if p < q]


def test_a_wide_box_is_in_few_cells(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 1e6, 1e6)], BOX)
    right = spark.createDataFrame([(2, 5.0, 5.0, 5.5, 5.5)], BOX).toDF("b_id", "b_xmin", "b_ymin", "b_xmax", "b_ymax")
    assert [r["b_id"] for r in G.box_join(left, right, 1.0).collect()] == [2]


@pytest.mark.parametrize("width, height", [(0.3, 0.2), (5.0, 0.05)])
def test_points_in_rings(spark, width, height):
    made = random.Random(3)
    rings = [(r, [(made.uniform(-2, 2), made.uniform(-2, 2)) for _ in range(3 + r % 9)]) for r in range(40)]
    places = [(i, made.uniform(-2.5, 2.5), made.uniform(-2.5, 2.5)) for i in range(60)]

    def inside(x, y, ring):
        odd = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
        return odd

    vertices = spark.createDataFrame([(r, i + 1, x, y) for r, ring in rings for i, (x, y) in enumerate(ring)], "ring long, seq int, x double, y double")
    found = G.points_in_rings(spark.createDataFrame(places, "pid long, px double, py double"), G.segments(vertices), width, height)
    assert sorted(map(tuple, found.collect())) == sorted((i, r) for i, x, y in places for r, ring in rings if inside(x, y, ring))
