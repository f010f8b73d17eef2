"""What large tables need: no side of a grid join goes through the driver, copies are met once."""

import random

import duckdb
import pytest

from parcelon.operators import geometry as G
from parcelon.plans import registry
from parcelon.plans.fixtures import vertices

from .conftest import SF
from .test_grid import BOX, many_boxes
from .test_queries import rows

GRID_JOINS = ["bbox_self_overlap", "chord_pairs", "exterior_screen", "hole_cover_fraction", "nested_containment", "segment_crossings"]


@pytest.mark.parametrize("name", GRID_JOINS)
def test_no_side_of_a_grid_join_is_broadcast(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("size", [0.05, 1.0])
def test_uncovered(spark, size):
    made = random.Random(5)
    boxes = [r for r in many_boxes(4, 80) if None in r or r[3] - r[1] < 2]
    boxes += [(200 + i, r[1], r[2], r[3], r[4]) for i, r in enumerate(boxes[:20])]
    boxes += [(300, -2.5, -2.5, -2.0, -2.4), (301, -2.5, -2.5, -2.4, -2.0), (302, -2.5, -2.5, -2.3, -2.3)]
    places = [(i, made.uniform(-3, 3), made.uniform(-3, 3)) for i in range(300)] + [(300, 2.0, 2.0), (301, -2.35, -2.35), (302, -2.45, -2.05), (303, -2.05, -2.45)]
    found = G.uncovered(spark.createDataFrame(places, "id long, px double, py double"), spark.createDataFrame(boxes, BOX), size)
    held = lambda x, y: any(None not in r and r[1] <= x <= r[3] and r[2] <= y <= r[4] for r in boxes)
    assert sorted(map(tuple, found.collect())) == [p for p in places if not held(*p[1:])]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The small tables three times with shifted keys, by which the copies of suppliers lie in one place."""
    folder = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    for table, by in {"part": "p_partkey + i * 20000 AS p_partkey", "supplier": "s_suppkey + i * 99000 AS s_suppkey", "lineitem": "l_orderkey + i * 150000 AS l_orderkey"}.items():
        con.sql(f"COPY (SELECT * REPLACE ({by}) FROM '{SF}/{table}.parquet', range(3) r(i)) TO '{folder}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


COPIED = ["assign_fallback", "hausdorff_partners", "point_cover_counts", "point_in_ring", "segment_crossings", "signature_match"]


@pytest.mark.parametrize("name", COPIED)
def test_tables_with_copies_equal_sql(spark, copies, name):
    folder, con = copies
    df = registry.QUERIES[name](spark, folder)
    other = con.sql(registry.SQL[name])
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())


def test_equal_zones_are_met_once(spark, copies, monkeypatch):
    met, join = [], G.box_join
    monkeypatch.setattr(G, "box_join", lambda a, b, *more: met.append(b.count()) or join(a, b, *more))
    folder, con = copies
    registry.QUERIES["assign_fallback"](spark, folder)
    assert met == [con.sql("SELECT count(DISTINCT (s_suppkey * 37 % 100, s_suppkey * 53 % 99)) FROM supplier").fetchall()[0][0]]


@pytest.mark.parametrize("across, thin", [(1.0, 0.25), (0.3, 2.0)])
def test_crossing_pairs(spark, across, thin):
    made = random.Random(6)
    at = lambda: made.choice((made.uniform(-3, 3), float(made.randint(-3, 3))))
    lines = [(i, i % 3, at(), at(), at(), at()) for i in range(120)] + [(120 + i, i % 3, x, 0.0, x, 1.0) for i, x in enumerate((0.0, 1.0, 2.0))]
    found = G.crossing_pairs(spark.createDataFrame(lines, "id long, kind_of int, x0 double, y0 double, x1 double, y1 double"), 1e-9, across, thin, "kind_of")

    def parts(p, o):
        one, two = ((p[4] - p[2]) * (o[k + 1] - p[3]) - (p[5] - p[3]) * (o[k] - p[2]) for k in (2, 4))
        return one > 1e-9 and two < -1e-9 or one < -1e-9 and two > 1e-9

    want = [(p[0], q[0]) for p in lines for q in lines if p[0] < q[0] and p[1] != q[1] and parts(p, q) and parts(q, p)]
    assert len(want) > 500 and sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["point_cover_counts", "point_in_ring"])
def test_equal_rings_and_places_are_met_once(spark, copies, monkeypatch, name):
    met, plain = [], G.places_in_classes
    monkeypatch.setattr(G, "places_in_classes", lambda p, r, *more: met.append((p.count(), r.count(), r.agg({"n": "sum"}).first()[0])) or plain(p, r, *more))
    folder, con = copies
    registry.QUERIES[name](spark, folder)
    places = con.sql("SELECT count(DISTINCT (s_suppkey * 37 % 500, s_suppkey * 53 % 600)) FROM supplier").fetchall()[0][0]
    rings = con.sql("SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3)").fetchall()[0][0]
    ((p, classes, n),) = met
    assert (p, n) == (places, rings) and classes <= rings / 3


def test_nothing_is_shuffled_once_copies_are_paired(spark):
    plan = registry.QUERIES["point_in_ring"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above, *below = plan.split("SortMergeJoin")
    assert len(below) == 1 and above.count("Generate explode") == 2 and "Exchange" not in above


def test_rings_are_classed_with_one_shuffle_by_ring_and_one_by_content(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    v = vertices(spark, SF)
    assert plan(v).count("Exchange hashpartitioning") == 1 and plan(G.ring_classes(v, "x", "y")).count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("digits", [None, 1])
def test_rings_of_one_table_meet_in_one_direction(spark, digits):
    shapes = {1: [(0, 0), (1, 0), (1, 1)], 2: [(0, 0), (1, 0.01), (1, 1)], 3: [(4, 4), (5, 4), (5, 5)]}
    like = {9: 1, 4: 2, 2: 1, 7: 1, 5: 3, 6: 2}  # rings by shape, the classes' least rings in another order
    rows = [(r, i + 1, float(x), float(y)) for r, s in like.items() for i, (x, y) in enumerate(shapes[s])]
    v = spark.createDataFrame(rows, "ring long, seq int, x double, y double")
    found = {(r.ring, r.b_ring): r.d for r in G.alike_rings(v, v, 0.02, 0.1, True, digits).collect()}
    far = 0.01 if digits is None else 0.0
    want = {(a, b): 0.0 if like[a] == like[b] else far for a in like for b in like if a < b and (like[a] == 3) == (like[b] == 3)}
    assert found == pytest.approx(want) and len(want) == 10
    both = [tuple(r) for r in G.alike_rings(v, v, 0.02, 0.1).where("ring < b_ring").select("ring", "b_ring").collect()]
    assert sorted(both) == sorted(found)


@pytest.mark.parametrize("name", ["point_cover_counts", "point_in_ring"])
def test_rings_are_grouped_by_content_unfiltered(spark, name):
    """A filter on what is made of a class would run on every ring, were it moved below the grouping."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Aggregate [flat#" in line)
    assert "Aggregate [ring#" in plan[at + 1]


def test_level_sides_and_many_sides(spark):
    made = random.Random(8)
    shapes = [[(made.randint(0, 4), made.randint(0, 4)) for _ in range(3 + r % 20)] for r in range(40)]
    rows = [(r, i + 1, float(x), float(y)) for r, ring in enumerate(shapes) for i, (x, y) in enumerate(ring)]
    places = [(5 * x + y, x - 0.25, float(y)) for x in range(6) for y in range(5)]

    def inside(x, y, ring):
        sides = zip(ring, ring[1:] + ring[:1], strict=True)
        return sum((y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in sides if y0 != y1) % 2 == 1

    v = spark.createDataFrame(rows, "ring long, seq int, x double, y double")
    found = G.ring_counts(spark.createDataFrame(places, "pid long, px double, py double"), G.segments(v), 2.0, 1.0)
    assert sorted(map(tuple, found.collect())) == sorted((i, sum(inside(x, y, s) for s in shapes)) for i, x, y in places)


def test_places_meet_rings_in_a_given_number_of_parts(spark):
    plan = registry.QUERIES["point_in_ring"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("SortMergeJoin")[1]
