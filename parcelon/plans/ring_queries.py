"""Queries that dissolve cells into rings and put rectangles around rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import scalars as S
from ..operators import geometry as G
from ..operators import parts as P
from ..operators import rings as R
from ..session import scratch
from .fixtures import SEGMENTS_SQL, VERTICES_SQL, T, ring_segments as segments_of, vertices

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cell_edges(spark, sf):
    """Unit cells by zone as edges with the cell on their left."""
    k = F.col("p_partkey")
    c = T(spark, sf, "part").select((F.col("p_size") % 3).alias("key"), (k % 50).cast("double").alias("x"), (F.floor(k / 50) % 40).cast("double").alias("y")).distinct()
    corners = ((0, 0), (1, 0), (1, 1), (0, 1))
    e = F.array(*(F.struct((F.col("x") + a).alias("x0"), (F.col("y") + b).alias("y0"), (F.col("x") + p).alias("x1"), (F.col("y") + q).alias("y1")) for (a, b), (p, q) in zip(corners, corners[1:] + corners[:1], strict=True)))
    return c.select("key", F.explode(e).alias("e")).select("key", "e.*")


@query("""WITH c AS (SELECT DISTINCT p_size % 3 AS zone, p_partkey % 50 AS cx, p_partkey // 50 % 40 AS cy FROM part),
g AS (SELECT zone, 'h' AS d, cx, cy FROM c UNION ALL SELECT zone, 'h', cx, cy + 1 FROM c UNION ALL SELECT zone, 'v', cx, cy FROM c UNION ALL SELECT zone, 'v', cx + 1, cy FROM c),
b AS (SELECT zone, count(*) AS n FROM (SELECT zone, d, cx, cy FROM g GROUP BY ALL HAVING count(*) = 1) GROUP BY zone)
SELECT zone, CAST(b.n AS BIGINT) AS vertices, CAST(a.n AS DOUBLE) AS area FROM b JOIN (SELECT zone, count(*) AS n FROM c GROUP BY zone) a USING (zone)""")
def dissolve(spark, sf):
    """Vertices and area, holes subtracted, of the rings that the cells of a zone dissolve into."""
    found = R.ring_areas(R.dissolve(cell_edges(spark, sf)))
    return found.groupBy(F.col("key").alias("zone")).agg(F.sum("n").alias("vertices"), F.sum("area").alias("area"))


@query(f"""WITH {VERTICES_SQL}, p AS (SELECT DISTINCT ring, x, y FROM v), e AS (SELECT a.ring, a.x AS ax, a.y AS ay, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS ux, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS uy
FROM p a JOIN p b ON a.ring = b.ring AND (a.x <> b.x OR a.y <> b.y)),
m AS (SELECT e.ring, ax, ay, ux, uy, min(ux * (p.y - ay) - uy * (p.x - ax)) AS low, max(ux * (p.y - ay) - uy * (p.x - ax)) - min(ux * (p.y - ay) - uy * (p.x - ax)) AS across, max(ux * p.x + uy * p.y) - min(ux * p.x + uy * p.y) AS along FROM e JOIN p ON e.ring = p.ring GROUP BY ALL),
r AS (SELECT ring, min(across * along) AS area FROM m WHERE low >= -1e-9 GROUP BY ring)
SELECT q.ring, round(coalesce(r.area, 0), 6) + 0.0 AS area FROM (SELECT DISTINCT ring FROM v) q LEFT JOIN r ON q.ring = r.ring""")
def obb(spark, sf):
    """Area of the least rectangle around each ring."""
    found = R.ring_arrays(vertices(spark, sf)).select("ring", R.least_rectangle("points").alias("r"))
    return found.select("ring", (F.round(F.col("r.length") * F.col("r.width"), 6) + 0.0).alias("area"))


@query(f"WITH {SEGMENTS_SQL} SELECT ring, seq, x0, y0, x1, y1 FROM s")
def ring_segments(spark, sf):
    """Each vertex with the next one; the last with the first."""
    return segments_of(spark, sf)


@query("SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (WHERE CAST(printf('%.1f', l_tax * 10) AS DOUBLE) = l_tax * 10) AS on_grid FROM lineitem GROUP BY 1")
def grid_check(spark, sf):
    """Values that equal themselves at so many decimal places."""
    return T(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.count_if(S.on_grid(F.col("l_tax") * 10, 1)).alias("on_grid"))


@query("""SELECT c_custkey AS id, 'gap-' || sha256(c_name)[1:16] AS short_id, regexp_full_match(lpad(CAST(c_custkey AS VARCHAR), 5, '0'), '[0-9]{5}') AS is_code,
round(c_custkey % 180 + (c_custkey % 60) / 60.0 + (c_custkey % 59) / 3600.0, 9) AS degrees FROM customer""")
def scalar_formats(spark, sf):
    k = F.col("c_custkey")
    angle = F.format_string("%d°%02d′%02d″", k % 180, k % 60, k % 59)
    return T(spark, sf, "customer").select(k.alias("id"), S.short_id("gap-", F.col("c_name")).alias("short_id"), S.is_code(F.lpad(k.cast("string"), 5, "0")).alias("is_code"), S.dms_to_degrees(angle).alias("degrees"))


_PARTS = """b AS (SELECT p_partkey AS k, p_partkey // 8 AS rec, CAST(p_partkey * 7 % 13 AS DOUBLE) AS x, CAST(p_partkey * 5 % 11 AS DOUBLE) AS y, 3.0 + p_size % 4 AS w, p_size % 9 AS s FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY k) - 1 AS i FROM b)"""


def box_records(spark, sf):
    """Records of eight boxes: each a clockwise shell and a hole that may lie in it, in another or in
    none; every fifth record has boxes only, counterclockwise."""
    k, s = F.col("p_partkey"), F.col("p_size")
    b = T(spark, sf, "part").select(k.alias("k"), F.floor(k / 8).alias("rec"), (k * 7 % 13).cast("double").alias("x"), (k * 5 % 11).cast("double").alias("y"), (s % 4 + 3).cast("double").alias("w"), (s % 9).alias("s"))

    def ring(x, y, w, corners):
        return F.array(*(F.struct((x + a * w).alias("x"), (y + c * w).alias("y")) for a, c in corners))

    left = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    shell = lambda corners: ring(F.col("x"), F.col("y"), F.col("w"), corners)
    hole = ring(F.col("x") + F.col("s") + 0.5, F.col("y") + 1.5, F.lit(0.25), left)
    rings = F.when(F.col("rec") % 5 == 0, F.array(shell(left))).otherwise(F.array(shell(left[::-1]), hole))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", rings.alias("rings")))), lambda v: v["rings"])
    return b.groupBy("rec").agg(F.flatten(listed).alias("rings"))


@query(f"""WITH {_PARTS} SELECT rec, CAST(i AS INTEGER) AS ring, 'shell' AS role, CAST(i AS INTEGER) AS shell FROM r WHERE rec % 5 = 0
UNION ALL SELECT rec, CAST(2 * i AS INTEGER), 'shell', CAST(2 * i AS INTEGER) FROM r WHERE rec % 5 <> 0
UNION ALL SELECT a.rec, CAST(2 * a.i + 1 AS INTEGER), 'hole', CAST(min(2 * o.i) AS INTEGER) FROM r a LEFT JOIN r o ON a.rec = o.rec AND o.x < a.x + a.s + 0.5 AND a.x + a.s + 0.5 < o.x + o.w AND o.y < a.y + 1.5 AND a.y + 1.5 < o.y + o.w
WHERE a.rec % 5 <> 0 GROUP BY a.rec, a.i""")
def shells_and_holes(spark, sf):
    """Rings of records as shells and holes with their shells."""
    return P.shells_and_holes(box_records(spark, sf)).drop("points")


_W = 1 / 298.257223563
_W2, _WE = repr(_W * (2 - _W)), repr((_W * (2 - _W)) ** 0.5)
_WQ = lambda y: f"((1 - {_W2}) * (sin(radians({y})) / (1 - {_W2} * sin(radians({y})) * sin(radians({y}))) + atanh({_WE} * sin(radians({y}))) / {_WE}))"


@query(f"WITH {SEGMENTS_SQL} SELECT ring, round(abs(sum(radians(x1 - x0) * ({_WQ('y0')} + {_WQ('y1')}))) * {G.AXIS**2 / 4!r} / 1e6, 3) AS km2 FROM s GROUP BY ring")
def ring_area_wgs84(spark, sf):
    return segments_of(spark, sf).groupBy("ring").agg(F.round(G.wgs84_area() / 1e6, 3).alias("km2"))


_SIN2 = f"(1 - {G.ECCENTRICITY2!r} * sin(radians(lat)) * sin(radians(lat)))"


@query(f"""WITH {SEGMENTS_SQL}, c AS (SELECT ring, (min(x) + max(x)) / 2 AS lon, (min(y) + max(y)) / 2 AS lat FROM v GROUP BY ring),
k AS (SELECT ring, lon, lat, {G.AXIS} / sqrt({_SIN2}) * cos(radians(lat)) AS e, {G.AXIS} * (1 - {G.ECCENTRICITY2!r}) / ({_SIN2} * sqrt({_SIN2})) AS n FROM c),
p AS (SELECT ring, radians(x0 - lon) * e AS ax, radians(y0 - lat) * n AS ay, radians(x1 - lon) * e AS bx, radians(y1 - lat) * n AS by_ FROM s JOIN k USING (ring))
SELECT ring, round(abs(sum(ax * by_ - bx * ay)) / 2 / 1e6, 3) AS km2, round(sum(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)) / 1000, 4) AS km FROM p GROUP BY ring""")
def ring_local_measures(spark, sf):
    """Area and perimeter of each ring on its own plane."""
    s = G.segments(G.local_plane(vertices(spark, sf)))
    return s.groupBy("ring").agg(F.round(F.abs(F.sum(G.cross())) / 2 / 1e6, 3).alias("km2"), F.round(F.sum(G.length()) / 1000, 4).alias("km"))


@query("SELECT o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1")
def typed_copy(spark, sf):
    """Rows in one folder per type, held against the table by fingerprint, and their numbers."""
    rows = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderpriority").alias("kind"))
    return sinks.typed_copy(rows, "kind", f"{scratch(spark)}/by_kind").groupBy("kind").agg(F.count("*").alias("n"))
