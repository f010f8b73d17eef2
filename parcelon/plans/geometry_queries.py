"""Queries on rings: segments, measures, parity, distances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from .fixtures import BOXES_SQL, POINTS_SQL, SEGMENTS_SQL, VERTICES_SQL, T, boxes, points, ring_segments, vertices

QUERIES, SQL = {}, {}
_S = f"WITH {SEGMENTS_SQL}"
_R2 = "6371008.8 * 6371008.8 / 2"
_SPHERE = f"abs(sum(radians(x1 - x0) * (sin(radians(y0)) + sin(radians(y1))))) * ({_R2})"
_E2 = repr(G.ECCENTRICITY2)
_E = repr(G.ECCENTRICITY2**0.5)
_Q = lambda y: f"((1 - {_E2}) * (sin(radians({y})) / (1 - {_E2} * sin(radians({y})) * sin(radians({y}))) + atanh({_E} * sin(radians({y}))) / {_E}))"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def per_ring(spark, sf, *measures):
    return ring_segments(spark, sf).groupBy("ring").agg(*measures)


@query(_S + " SELECT ring, seq, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM s")
def segments(spark, sf):
    return ring_segments(spark, sf).select("ring", "seq", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(_S + f" SELECT ring, round({_SPHERE} / 1e6, 3) AS km2 FROM s GROUP BY ring")
def ring_area_sphere(spark, sf):
    return per_ring(spark, sf, F.round(G.sphere_area() / 1e6, 3).alias("km2"))


@query(_S + f" SELECT ring, round(abs(sum(radians(x1 - x0) * ({_Q('y0')} + {_Q('y1')}))) * {G.AXIS**2 / 4!r} / 1e6, 3) AS km2 FROM s GROUP BY ring")
def ring_area_grs80(spark, sf):
    return per_ring(spark, sf, F.round(G.grs80_area() / 1e6, 3).alias("km2"))


@query(_S + " SELECT ring, round(abs(sum(x0 * y1 - x1 * y0)) / 2 * (111320.0 * 111320.0) * cos(radians(avg(y0))) / 1e6, 2) AS km2 FROM s GROUP BY ring")
def ring_area_planar(spark, sf):
    return per_ring(spark, sf, F.round(G.planar_area() / 1e6, 2).alias("km2"))


@query(_S + " SELECT ring, round(sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))), 6) AS perimeter FROM s GROUP BY ring")
def ring_perimeter(spark, sf):
    return per_ring(spark, sf, F.round(F.sum(G.length()), 6).alias("perimeter"))


@query(_S + ", f AS (SELECT ring, x AS fx, y AS fy FROM v WHERE seq = 1), a AS (SELECT ring, round(sum((x0 - fx) * (y1 - fy) - (x1 - fx) * (y0 - fy)) / 2, 6) AS area FROM s JOIN f USING (ring) GROUP BY ring) SELECT ring, area + 0.0 AS area, CASE WHEN area > 0 THEN 'ccw' WHEN area < 0 THEN 'cw' ELSE 'flat' END AS turn FROM a")
def ring_orientation(spark, sf):
    """Signed area, taken from the first vertex for precision."""
    s = ring_segments(spark, sf)
    first = Window.partitionBy("ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("fx", F.first("x0").over(first)).withColumn("fy", F.first("y0").over(first))
    a = s.groupBy("ring").agg(F.round(F.sum((F.col("x0") - F.col("fx")) * (F.col("y1") - F.col("fy")) - (F.col("x1") - F.col("fx")) * (F.col("y0") - F.col("fy"))) / 2, 6).alias("area"))
    return a.select("ring", (F.col("area") + 0.0).alias("area"), F.when(F.col("area") > 0, "ccw").when(F.col("area") < 0, "cw").otherwise("flat").alias("turn"))


@query(f"WITH {VERTICES_SQL} SELECT ring, round(min(x), 6) AS xmin, round(min(y), 6) AS ymin, round(max(x), 6) AS xmax, round(max(y), 6) AS ymax, count(*) AS vertices FROM v GROUP BY ring")
def feature_bounds(spark, sf):
    return vertices(spark, sf).groupBy("ring").agg(*(F.round(f(c), 6).alias(f"{c}{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("vertices"))


@query(_S + ", a AS (SELECT ring, sum(x0 * y1 - x1 * y0) AS c, sum((x0 + x1) * (x0 * y1 - x1 * y0)) AS sx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) AS sy FROM s GROUP BY ring) SELECT ring, round(sx / (3 * c), 3) AS cx, round(sy / (3 * c), 3) AS cy FROM a WHERE abs(c) > 0.1")
def ring_centroid(spark, sf):
    a = per_ring(spark, sf, F.sum(G.cross()).alias("c"), F.sum((F.col("x0") + F.col("x1")) * G.cross()).alias("sx"), F.sum((F.col("y0") + F.col("y1")) * G.cross()).alias("sy"))
    return a.where(F.abs("c") > 0.1).select("ring", F.round(F.col("sx") / (3 * F.col("c")), 3).alias("cx"), F.round(F.col("sy") / (3 * F.col("c")), 3).alias("cy"))


@query(_S + f""", f AS (SELECT ring, x AS fx, y AS fy FROM v WHERE seq = 1), r AS (SELECT ring, fx, fy, x0 - fx AS ux, y0 - fy AS uy, x1 - fx AS wx, y1 - fy AS wy FROM s JOIN f USING (ring)),
a AS (SELECT ring, any_value(fx) AS fx, any_value(fy) AS fy, sum(ux * wy - wx * uy) AS c, sum(sqrt((wx - ux) ** 2 + (wy - uy) ** 2)) AS l, sum((ux + wx) * (ux * wy - wx * uy)) AS sx, sum((uy + wy) * (ux * wy - wx * uy)) AS sy FROM r GROUP BY ring)
SELECT ring, CASE WHEN abs(c) > {G.FLAT!r} * l THEN round(fx + sx / (3 * c), 6) END AS cx, CASE WHEN abs(c) > {G.FLAT!r} * l THEN round(fy + sy / (3 * c), 6) END AS cy FROM a""")
def ring_centroid_all(spark, sf):
    """Every ring, however small; ring_centroid leaves out those below 0.05 square degrees."""
    return G.centroids(ring_segments(spark, sf)).select("ring", *(F.round(n, 6).alias(n) for n in ("cx", "cy")))


_LEN = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"


@query(_S + f" SELECT ring, seq, round(coalesce(sum({_LEN}) OVER (PARTITION BY ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS arc, round(sum({_LEN}) OVER (PARTITION BY ring), 6) AS ring_length FROM s")
def arc_length(spark, sf):
    w = Window.partitionBy("ring")
    before = w.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return ring_segments(spark, sf).select("ring", "seq", F.round(F.coalesce(F.sum(G.length()).over(before), F.lit(0.0)), 6).alias("arc"), F.round(F.sum(G.length()).over(w), 6).alias("ring_length"))


@query(_S + f", t AS (SELECT {_LEN} AS d FROM s) SELECT count(*) AS n, count(*) FILTER (WHERE d = 0) AS zero, count(*) FILTER (WHERE d > 3) AS longer, " + ", ".join(f"round(quantile_cont(d, {q}), 6) AS p{n}" for q, n in ((0.5, "50"), (0.9, "90"), (0.99, "99"), (0.999, "999"), (1.0, "100"))) + " FROM t")
def segment_stats(spark, sf):
    t = ring_segments(spark, sf).select(G.length().alias("d"))
    a = t.agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("zero"), F.count_if(F.col("d") > 3).alias("longer"))
    shares = {"50": 0.5, "90": 0.9, "99": 0.99, "999": 0.999, "100": 1.0}
    q = G.exact_quantiles(t, "d", list(shares.values())).agg(*(F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 6).alias(f"p{n}") for n, s in shares.items()))
    return a.join(F.broadcast(q), F.lit(True))  # one row each


_FEATURES = _S + f", a AS (SELECT ring, {_SPHERE} AS area FROM s GROUP BY ring), f AS (SELECT ring // 4 AS fid, ring, row_number() OVER (PARTITION BY ring // 4 ORDER BY ring) - 1 AS idx, area FROM a)"


def features(spark, sf):
    """Four rings of consecutive numbers are a feature; the first is its exterior."""
    a = per_ring(spark, sf, G.sphere_area().alias("area")).withColumn("fid", F.floor(F.col("ring") / 4).cast("long"))
    return a.withColumn("idx", (F.row_number().over(Window.partitionBy("fid").orderBy("ring")) - 1).cast("long"))


@query(_FEATURES + " SELECT fid, ring, idx AS ring_idx FROM f WHERE idx = 0 OR area >= 5e10")
def drop_small_rings(spark, sf):
    """Exteriors stay; holes stay from the threshold on."""
    return features(spark, sf).where((F.col("idx") == 0) | (F.col("area") >= 5e10)).select("fid", "ring", F.col("idx").alias("ring_idx"))


@query(_FEATURES + " SELECT fid, count(*) FILTER (WHERE idx > 0) AS holes, round(coalesce(sum(area) FILTER (WHERE idx > 0), 0) / 1e6, 2) AS km2 FROM f GROUP BY fid")
def hole_census(spark, sf):
    hole = F.col("idx") > 0
    return features(spark, sf).groupBy("fid").agg(F.count_if(hole).alias("holes"), F.round(F.sum(F.when(hole, F.col("area")).otherwise(0.0)) / 1e6, 2).alias("km2"))


@query(_FEATURES + " SELECT fid, ring, round(area / 1e6, 2) AS km2, k FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY round(area / 1e6, 2) DESC, ring) AS k FROM f) WHERE k <= 3")
def topk_components(spark, sf):
    f = features(spark, sf).withColumn("km2", F.round(F.col("area") / 1e6, 2))
    return f.withColumn("k", F.row_number().over(Window.partitionBy("fid").orderBy(F.desc("km2"), "ring")).cast("long")).where("k <= 3").select("fid", "ring", "km2", "k")


@query(_S + f" SELECT ring, round({_SPHERE} / 1e6, 2) AS km2 FROM s GROUP BY ring ORDER BY km2 DESC, ring LIMIT 50")
def topk_area(spark, sf):
    """A report of the 50 largest."""
    return per_ring(spark, sf, F.round(G.sphere_area() / 1e6, 2).alias("km2")).orderBy(F.desc("km2"), "ring").limit(50)


@query(_S + f", m AS (SELECT ring, {_SPHERE} AS a, sum({_LEN}) * 111320 AS p FROM s GROUP BY ring) SELECT ring, round(p / 2, 1) AS length, round(2 * a / p, 1) AS width FROM m WHERE p > 0")
def width_proxy(spark, sf):
    m = per_ring(spark, sf, G.sphere_area().alias("a"), (F.sum(G.length()) * 111320).alias("p")).where("p > 0")
    return m.select("ring", F.round(F.col("p") / 2, 1).alias("length"), F.round(2 * F.col("a") / F.col("p"), 1).alias("width"))


@query(_S + " SELECT ring, count(*) >= 3 AS enough, bool_and(isfinite(x0) AND isfinite(y0)) AS finite, count(DISTINCT (round(x0, 6), round(y0, 6))) = count(*) AS simple FROM s GROUP BY ring")
def ring_validity(spark, sf):
    """Enough vertices, all finite, none repeated."""
    finite = ~F.isnan("x0") & ~F.isnan("y0") & (F.abs("x0") < float("inf")) & (F.abs("y0") < float("inf"))
    return per_ring(spark, sf, (F.count("*") >= 3).alias("enough"), F.bool_and(finite).alias("finite"), (F.countDistinct(F.round("x0", 6), F.round("y0", 6)) == F.count("*")).alias("simple"))


_PART = lambda s, o: "(" + " OR ".join(f"({_AT(s, o, 0)} {p} AND {_AT(s, o, 1)} {q})" for p, q in (("> 1e-9", "< -1e-9"), ("< -1e-9", "> 1e-9"))) + ")"
_AT = lambda s, o, k: f"(({s}.x1 - {s}.x0) * ({o}.y{k} - {s}.y0) - ({s}.y1 - {s}.y0) * ({o}.x{k} - {s}.x0))"


@query(_S + f""", n AS (SELECT ring, count(*) AS n FROM s GROUP BY ring), x AS (SELECT a.ring, count(*) AS k FROM s a JOIN s b ON a.ring = b.ring AND b.seq >= a.seq + 2 JOIN n ON n.ring = a.ring WHERE NOT (a.seq = 1 AND b.seq = n) AND {_PART('a', 'b')} AND {_PART('b', 'a')} GROUP BY a.ring),
m AS (SELECT ring, count(*) >= 3 AS enough, bool_and(isfinite(x0) AND isfinite(y0)) AS finite, count(DISTINCT (round(x0, 6), round(y0, 6))) = count(*) AS apart FROM s GROUP BY ring)
SELECT m.*, coalesce(k, 0) AS crossings, apart AND k IS NULL AS simple FROM m LEFT JOIN x USING (ring)""")
def ring_simplicity(spark, sf):
    """As ring_validity, whose 'simple' only means that no vertex is repeated (here 'apart'), and
    the pairs of segments that cross properly; simple rings have none."""
    s = ring_segments(spark, sf)
    x = G.self_crossings(s).groupBy("ring").agg(F.count("*").alias("crossings"))
    found = ring_validity(spark, sf).withColumnRenamed("simple", "apart").join(x, "ring", "left")
    return found.select("ring", "enough", "finite", "apart", F.coalesce("crossings", F.lit(0)).alias("crossings"), (F.col("apart") & F.col("crossings").isNull()).alias("simple"))


_PIP = _S + """, p AS (SELECT s_suppkey AS pid, 130.003 + (s_suppkey * 37 % 500) / 100.0 AS px, 30.0007 + (s_suppkey * 53 % 600) / 100.0 AS py FROM supplier),
hit AS (SELECT pid, ring FROM p JOIN s ON (y0 > py) <> (y1 > py) AND px < x0 + (py - y0) * (x1 - x0) / (y1 - y0) GROUP BY pid, ring HAVING count(*) % 2 = 1)"""


def targets(spark, sf):
    k = F.col("s_suppkey")
    return T(spark, sf, "supplier").select(k.alias("pid"), (130.003 + (k * 37 % 500) / 100.0).alias("px"), (30.0007 + (k * 53 % 600) / 100.0).alias("py"))


#: A cell is as wide as these rings are, and a third as high.
_CELL = 5.0, 1.0


@query(_PIP + " SELECT pid, ring FROM hit")
def point_in_ring(spark, sf):
    """Points in rings by even-odd parity."""
    return G.points_in_rings(targets(spark, sf), ring_segments(spark, sf), *_CELL)


@query(_PIP + " SELECT pid, count(ring) AS n FROM p LEFT JOIN hit USING (pid) GROUP BY pid")
def point_cover_counts(spark, sf):
    return G.ring_counts(targets(spark, sf), ring_segments(spark, sf), *_CELL)


_MEET = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


def other(frame):
    return frame.toDF(*(f"b_{c}" for c in frame.columns))


@query(f"WITH {BOXES_SQL} SELECT a.id AS a, b.id AS b, round((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)), 9) AS area FROM box a JOIN box b ON a.id < b.id AND {_MEET} WHERE least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin) AND least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin)")
def bbox_self_overlap(spark, sf):
    """Overlaps of positive area; mere contact is none."""
    b = boxes(spark, sf)
    w, h = F.least("xmax", "b_xmax") - F.greatest("xmin", "b_xmin"), F.least("ymax", "b_ymax") - F.greatest("ymin", "b_ymin")
    return G.box_join(b, other(b), 1.0, same=True).where((w > 0) & (h > 0)).select(F.col("id").alias("a"), F.col("b_id").alias("b"), F.round(w * h, 9).alias("area"))


@query(f"WITH {BOXES_SQL}, {POINTS_SQL} SELECT a.id, b_id FROM box a JOIN pb ON a.xmin <= qx / 2 AND qx / 2 <= a.xmax AND a.ymin <= qy / 2 AND qy / 2 <= a.ymax")
def bbox_join(spark, sf):
    _, p = points(spark, sf)
    p = p.select("b_id", *((F.col(c) / 2).alias(f"b_{n}{m}") for c, n in (("bx", "x"), ("by", "y")) for m in ("min", "max")))
    return G.box_join(boxes(spark, sf), p, 1.0).select("id", "b_id")


_NEAR = f"WITH {POINTS_SQL}, near AS (SELECT id, b_id, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS d FROM pa, pb WHERE abs(x - qx) <= 8 AND abs(y - qy) <= 8 AND sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) <= 8)"


@query(_NEAR + " SELECT id, round(min(d), 6) AS nearest FROM pa LEFT JOIN near USING (id) GROUP BY id")
def nearest_within(spark, sf):
    a, b = points(spark, sf)
    found = G.near_pairs(a, b, 8.0).groupBy("id").agg(F.round(F.min("d"), 6).alias("nearest"))
    return a.select("id").join(found, "id", "left")


@query(_NEAR + " SELECT id, b_id, round(d, 6) AS d, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 6), b_id) AS k FROM near) WHERE k <= 6 AND id % 7 <> b_id % 7")
def knn_other_feature(spark, sf):
    """The six nearest first, then only those of another feature."""
    a, b = points(spark, sf)
    near = G.near_pairs(a, b, 8.0).select("id", "b_id", F.round("d", 6).alias("d"))
    return near.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("d", "b_id")).cast("long")).where("k <= 6 AND id % 7 <> b_id % 7")


@query(_NEAR + " SELECT count(*) FILTER (WHERE d >= 0 AND d < 2) AS h0, count(*) FILTER (WHERE d >= 2 AND d < 4) AS h1, count(*) FILTER (WHERE d >= 4 AND d < 6) AS h2, count(*) FILTER (WHERE d >= 6 AND d <= 8) AS h3 FROM near")
def distance_histogram(spark, sf):
    """Half-open bins; the last one is closed."""
    d = F.col("d")
    return G.near_pairs(*points(spark, sf), 8.0).agg(F.count_if((d >= 0) & (d < 2)).alias("h0"), F.count_if((d >= 2) & (d < 4)).alias("h1"), F.count_if((d >= 4) & (d < 6)).alias("h2"), F.count_if((d >= 6) & (d <= 8)).alias("h3"))


@query(f"WITH {POINTS_SQL} SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM pa a JOIN pa b ON a.id < b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1")
def radius_pairs(spark, sf):
    a, _ = points(spark, sf)
    return G.near_pairs(a, a.toDF("b_id", "bx", "by"), 1.0).where("id < b_id").select(F.col("id").alias("a"), F.col("b_id").alias("b"), F.round("d", 6).alias("d"))


@query("SELECT event_id, round(6378137.0 / sqrt(1 - 0.0066943800229 * pow(sin(radians(value / 10)), 2)) * cos(radians(value / 10)), 3) AS px, round(6378137.0 * (1 - 0.0066943800229) / sqrt(1 - 0.0066943800229 * pow(sin(radians(value / 10)), 2)) * sin(radians(value / 10)), 3) AS pz FROM events")
def ecef(spark, sf):
    s, c = F.sin(F.radians(F.col("value") / 10)), F.cos(F.radians(F.col("value") / 10))
    n = 6378137.0 / F.sqrt(1 - 0.0066943800229 * F.pow(s, F.lit(2)))
    return T(spark, sf, "events").select("event_id", F.round(n * c, 3).alias("px"), F.round(n * (1 - 0.0066943800229) * s, 3).alias("pz"))


@query("WITH t AS (SELECT event_id, value / 7 AS v FROM events) SELECT event_id, round(v, 9) = v AS on_grid, round(round(v / 0.01) * 0.01, 6) AS snapped FROM t")
def snap_grid(spark, sf):
    """On the nine-decimal grid or not; and snapped to a coarser one."""
    v = F.col("value") / 7
    return T(spark, sf, "events").select("event_id", (F.round(v, 9) == v).alias("on_grid"), F.round(F.round(v / 0.01) * 0.01, 6).alias("snapped"))


@query(f"WITH {VERTICES_SQL} SELECT count(*) AS sampled, round(avg(CASE WHEN round(x, 1) = x THEN 1.0 ELSE 0.0 END), 6) AS share FROM v WHERE (seq - 1) % 10 = 0")
def grid_sample_rate(spark, sf):
    """Every tenth vertex of each ring, counted anew in each."""
    return vertices(spark, sf).where("(seq - 1) % 10 = 0").agg(F.count("*").alias("sampled"), F.round(F.avg(F.when(F.round("x", 1) == F.col("x"), 1.0).otherwise(0.0)), 6).alias("share"))


@query("""WITH e AS (SELECT p_partkey % 50 AS cx, p_partkey // 50 % 40 AS cy, p_size % 3 AS zone FROM part),
c AS (SELECT DISTINCT zone, cx, cy FROM e), g AS (SELECT zone, 'h' AS d, cx, cy FROM c UNION ALL SELECT zone, 'h', cx, cy + 1 FROM c UNION ALL SELECT zone, 'v', cx, cy FROM c UNION ALL SELECT zone, 'v', cx + 1, cy FROM c)
SELECT zone, count(*) AS boundary FROM (SELECT zone, d, cx, cy FROM g GROUP BY ALL HAVING count(*) = 1) GROUP BY zone""")
def dissolve_edges(spark, sf):
    """Coverage dissolve of unit cells: edges that two cells of a zone share cancel out."""
    k = F.col("p_partkey")
    c = T(spark, sf, "part").select((F.col("p_size") % 3).alias("zone"), (k % 50).alias("cx"), (F.floor(k / 50) % 40).alias("cy")).distinct()
    e = F.array(*(F.struct(F.lit(d).alias("d"), (F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for d, dx, dy in (("h", 0, 0), ("h", 0, 1), ("v", 0, 0), ("v", 1, 0))))
    edges = c.select("zone", F.explode(e).alias("e")).groupBy("zone", "e").agg(F.count("*").alias("n")).where("n = 1")
    return edges.groupBy("zone").agg(F.count("*").alias("boundary"))


@query(_S + ", c AS (SELECT ring, seq, x0 AS px, y0 AS py FROM s WHERE seq = 1), d AS (SELECT s.ring, px, py, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM s JOIN c USING (ring) WHERE s.seq = 2), t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE least(1, greatest(0, ((px - x0) * dx + (py - y0) * dy) / nullif(dx * dx + dy * dy, 0))) END AS t FROM d) SELECT ring, round(sqrt((px - x0 - t * dx) ** 2 + (py - y0 - t * dy) ** 2), 6) AS d FROM t")
def point_segment_distance(spark, sf):
    """The first vertex of a ring and its second segment: clamped projection."""
    s = ring_segments(spark, sf)
    first = s.where("seq = 1").select("ring", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return s.where("seq = 2").join(first, "ring").select("ring", F.round(G.point_segment_distance(F.col("px"), F.col("py")), 6).alias("d"))


_T = "CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE least(1, greatest(0, ((px - x0) * dx + (py - y0) * dy) / nullif(dx * dx + dy * dy, 0))) END"


@query(_S + f", d AS (SELECT v.ring, v.seq, s.seq AS segment, v.x AS px, v.y AS py, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM v JOIN s USING (ring)), t AS (SELECT *, {_T} AS t FROM d) SELECT ring, seq, segment, round(sqrt((px - x0 - t * dx) ** 2 + (py - y0 - t * dy) ** 2), 6) AS d FROM t")
def vertex_segment_distances(spark, sf):
    """Every vertex of a ring and every segment of it, where point_segment_distance takes one pair."""
    s = ring_segments(spark, sf).withColumnRenamed("seq", "segment")
    v = vertices(spark, sf)
    return v.join(s, "ring").select("ring", "seq", "segment", F.round(G.point_segment_distance(F.col("x"), F.col("y")), 6).alias("d"))


_VV = f"WITH {VERTICES_SQL} SELECT a.ring, CAST(a.seq AS INTEGER) AS i, CAST(b.seq AS INTEGER) AS j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM v a JOIN v b ON a.ring = b.ring AND b.seq >= a.seq + 2 JOIN (SELECT ring, max(seq) AS n FROM v GROUP BY ring) m ON m.ring = a.ring WHERE NOT (a.seq = 1 AND b.seq = n)"


@query(_VV + " AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.35")
def nearby_pairs(spark, sf):
    """Close vertices of a ring that are not neighbours, its closure counted as neighbourhood."""
    v = vertices(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("ring")))
    b = v.select("ring", F.col("seq").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    return v.join(b, "ring").where("j >= seq + 2 AND NOT (seq = 1 AND j = n)").where(d <= 0.35).select("ring", F.col("seq").alias("i"), "j", F.round(d, 6).alias("d"))
