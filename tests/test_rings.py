import numpy as np
import pytest

from parcelon.operators import rings as R

CELL = ((0, 0), (1, 0), (1, 1), (0, 1))


def edges(spark, cells):
    rows = []
    for key, x, y in cells:
        at = [(float(x + a), float(y + b)) for a, b in CELL]
        rows += [(key, *p, *q) for p, q in zip(at, at[1:] + at[:1])]
    return spark.createDataFrame(rows, "key int, x0 double, y0 double, x1 double, y1 double")


def rings(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["key"], r["ring"], r["seq"])):
        found.setdefault((r["key"], r["ring"]), []).append((r["x"], r["y"]))
    return found


def test_hole_touching_corners_and_two_keys(spark):
    # Key 1: a frame of 3 x 3 cells with a hole, and a cell that touches a corner of it. Key 2: the hole.
    frame = [(1, x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    found = rings(R.dissolve(edges(spark, [*frame, (1, 3, 3), (2, 1, 1)])))
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2
    assert sorted((k[0], len(p), area(p)) for k, p in found.items()) == [(1, 4, -1.0), (1, 4, 1.0), (1, 12, 9.0), (2, 4, 1.0)]
    for p in found.values():  # neighbours in order are joined by an edge
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(p, p[1:] + p[:1]))


def test_overlap_fails_and_empty_gives_none(spark):
    with pytest.raises(Exception, match="overlap"):
        R.dissolve(edges(spark, [(1, 0, 0), (1, 0, 0)])).collect()
    assert R.dissolve(edges(spark, [(1, 0, 0)]).where("key = 9")).collect() == []


def test_rectangle_of_turned_points():
    a = np.deg2rad(30)
    turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    points = np.array([(0, 0), (4, 0), (4, 1), (0, 1), (2, 0.5), (2, 0)]) @ turn.T
    assert R.rectangle(points) == pytest.approx((4, 1))
    assert R.rectangle(np.array([(1.0, 1.0), (1.0, 1.0)])) == (0.0, 0.0)
    assert R.rectangle(np.array([(0.0, 0.0), (3.0, 4.0), (0.0, 0.0)])) == pytest.approx((5, 0))
