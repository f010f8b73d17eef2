"""Queries on the build, on overlays, and on small scalar operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import build as B
from ..operators import geometry as G
from ..operators import overlay as O
from ..operators import versions as V
from ..session import scratch
from .fixtures import BOUND_SQL, BOXES_SQL, MATCH_SQL, POINTS_SQL, RECORDS_SQL, RULES, VERTICES_SQL, T, boxes, points, records, rules_sql, vertices
from .rule_queries import free_rules, rule_boxes
from .rule_queries import _AB

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The rules with one that takes all other records: the build fails on a record without a rule.
WHOLE = [*RULES, dict(rule_id=99, zone=13)]
SPLIT = ["ASIA", "EUROPE"]
COLUMNS = {"prefecture": "prefecture", "municipality": "municipality", "ward": "county", "code": "code"}
_BUILT = f"""WITH {rules_sql(WHOLE)}, {RECORDS_SQL}, built AS (SELECT a.*, (SELECT arg_min(r.zone, r.rule_id) FROM rules r WHERE {MATCH_SQL} AND {BOUND_SQL}) AS zone,
CASE WHEN prefecture IN ('ASIA', 'EUROPE') THEN code ELSE substr(code, 1, 2) || '000' END AS unit_code,
CASE WHEN prefecture IN ('ASIA', 'EUROPE') THEN municipality || county ELSE prefecture END AS unit_name FROM records a)"""


def built(spark, sf):
    """Records whose boxes are their points; each box lies in one zone."""
    boxed = records(spark, sf).select("*", *(F.col(v).alias(n) for n, v in zip(B.BOX, ("lon", "lat", "lon", "lat"), strict=True))).drop("lon", "lat")
    return B.assign_zones(boxed, WHOLE, "id")


def zones(spark):
    z = F.col("id")
    return spark.range(1, 14).select(z.cast("int").alias("zone"), F.concat(F.lit("Z"), F.lpad(z.cast("string"), 2, "0")).alias("zone_roman"), (z + 6668).cast("string").alias("epsg"))


@query(_BUILT + """ SELECT id, CAST(zone AS VARCHAR) AS "ZONE", 'Z' || lpad(CAST(zone AS VARCHAR), 2, '0') AS "ZONE_ROMAN", CAST(zone + 6668 AS VARCHAR) AS "EPSG", unit_code AS "UNIT_CODE", unit_name AS "UNIT_NAME" FROM built""")
def build_records(spark, sf):
    """The fields that the build adds to each record."""
    return B.enriched(built(spark, sf), zones(spark), SPLIT, COLUMNS).select("id", *B.ADDED)


@query(_BUILT + " SELECT code, min(prefecture) AS prefecture, min(municipality) AS municipality, array_to_string(list_sort(list(DISTINCT zone)), ';') AS zones, count(*) AS polygons FROM built GROUP BY code")
def build_table(spark, sf):
    return B.key_table(built(spark, sf), "code", ["prefecture", "municipality"])


@query(_BUILT + """, t AS (SELECT code, count(DISTINCT zone) AS z FROM built GROUP BY code) SELECT 'polygons' AS item, count(*) AS value FROM built UNION ALL SELECT 'codes', count(*) FROM t UNION ALL SELECT 'split codes', count(*) FROM t WHERE z > 1
UNION ALL SELECT 'zone ' || zone, count(*) FROM built GROUP BY zone UNION ALL SELECT 'dissolved by zone', count(DISTINCT zone) FROM built
UNION ALL SELECT 'dissolved by unit', count(DISTINCT (unit_code, zone)) FROM built UNION ALL SELECT 'dissolved by municipality', count(DISTINCT (code, zone)) FROM built""")
def build_summary(spark, sf):
    rows = built(spark, sf)
    return B.summary(rows, B.key_table(rows, "code", ["prefecture", "municipality"]), COLUMNS, SPLIT)


@query(_AB[:-1] + " SELECT b.id, coalesce(string_agg(printf('%s=%g', axis, v), ' ' ORDER BY axis DESC, v), '') AS lines FROM b LEFT JOIN lines ON lines.id = b.id GROUP BY b.id")
def box_line_names(spark, sf):
    """The lines that cut a box, as text: meridians first, then parallels."""
    return B.box_report(rule_boxes(spark, sf), free_rules(), "id").select("id", F.array_join("lines", " ").alias("lines"))


_LEG = "(0.5 + (id % 3) * 0.5)"


@query(f"""WITH {BOXES_SQL}, t AS (SELECT id, (xmax - xmin) * (ymax - ymin) AS whole, {_LEG} AS t FROM box), o AS (SELECT id, whole, whole * t * t / 2 AS tri, whole * CASE WHEN t <= 1 THEN t * t / 2 ELSE 1 - (2 - t) * (2 - t) / 2 END AS met FROM t)
SELECT id AS key, round((whole - met) * 1000 / 7, 4) + 0.0 AS a_only, round((tri - met) * 1000 / 7, 4) + 0.0 AS b_only, round(met * 1000 / 7, 4) AS "both" FROM o""")
def overlay_areas(spark, sf):
    """A box against a triangle at its corner, whose legs are a half, one or one and a half sides; in
    sevenths of a thousandth, so that no value lies halfway between two that are shown."""
    b = boxes(spark, sf).withColumn("t", 0.5 + (F.col("id") % 3) * 0.5)
    right, top = F.col("xmin") + F.col("t") * (F.col("xmax") - F.col("xmin")), F.col("ymin") + F.col("t") * (F.col("ymax") - F.col("ymin"))
    x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))

    def ring(side, *corners):
        edges = zip(corners, [*corners[1:], corners[0]], strict=True)
        return [F.struct(F.lit(side).alias("side"), p[0].alias("x0"), p[1].alias("y0"), q[0].alias("x1"), q[1].alias("y1")) for p, q in edges]

    every = F.array(*ring("a", (x0, y0), (x1, y0), (x1, y1), (x0, y1)), *ring("b", (x0, y0), (right, y0), (x0, top)))
    found = O.overlay(b.select(F.col("id").alias("key"), F.explode(every).alias("s")).select("key", "s.*"))
    return found.select("key", *((F.round(F.col(c) * 1000 / 7, 4) + 0.0).alias(c) for c in ("a_only", "b_only", "both")))


@query(f"WITH {VERTICES_SQL} SELECT ring, seq, coalesce(lag(seq) OVER w, max(seq) OVER (PARTITION BY ring)) AS before, coalesce(lead(seq) OVER w, min(seq) OVER (PARTITION BY ring)) AS after FROM v WINDOW w AS (PARTITION BY ring ORDER BY seq)")
def cyclic_neighbours(spark, sf):
    """The vertices before and after each one, the ends of a ring being neighbours."""
    whole = Window.partitionBy("ring")
    order = whole.orderBy("seq")
    return vertices(spark, sf).select("ring", "seq", F.coalesce(F.lag("seq").over(order), F.max("seq").over(whole)).alias("before"), F.coalesce(F.lead("seq").over(order), F.min("seq").over(whole)).alias("after"))


@query(f"WITH {VERTICES_SQL} SELECT DISTINCT round(a.x, 6) AS x, round(a.y, 6) AS y FROM v a JOIN v b ON a.x = b.x AND a.y = b.y WHERE a.ring % 50 = 0 AND b.ring % 50 = 1")
def shared_places(spark, sf):
    """Places of two sets of vertices that are equal bit for bit; each side is made distinct first."""
    v = vertices(spark, sf)
    side = lambda n: v.where(F.col("ring") % 50 == n).select("x", "y").distinct()
    return side(0).join(side(1), ["x", "y"]).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).distinct()


@query("WITH t AS (SELECT event_id, value - 180.0 * floor(value / 180.0) AS lon, event_id % 160 - 80.0 AS lat FROM events) SELECT event_id, round(6378137.0 * radians(lon), 3) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) + 0.0 AS my FROM t")
def mercator(spark, sf):
    """Web Mercator metres of a longitude and latitude."""
    lon, lat = F.col("value") - 180.0 * F.floor(F.col("value") / 180.0), F.col("event_id") % 160 - 80.0
    return T(spark, sf, "events").select("event_id", F.round(F.radians(lon) * 6378137.0, 3).alias("mx"), (F.round(F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * 6378137.0, 3) + 0.0).alias("my"))


_E2 = repr(G.ECCENTRICITY2)
_REACH = 2500.0


@query(f"""WITH {POINTS_SQL}, g AS (SELECT id, radians(130 + x / 100) AS lon, radians(30 + y / 100) AS lat, {G.AXIS} / sqrt(1 - {_E2} * sin(radians(30 + y / 100)) * sin(radians(30 + y / 100))) AS n FROM pa),
p AS (SELECT id, n * cos(lat) * cos(lon) AS x, n * cos(lat) * sin(lon) AS y, n * (1 - {_E2}) * sin(lat) AS z FROM g)
SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 3) AS d FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= {_REACH} AND abs(a.y - b.y) <= {_REACH} WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= {_REACH}""")
def chord_pairs(spark, sf):
    """Places within a distance through the ellipsoid, in three dimensions."""
    a, _ = points(spark, sf)
    found = G.chord_pairs(a.select("id", (130 + F.col("x") / 100).alias("lon"), (30 + F.col("y") / 100).alias("lat")), _REACH)
    return found.select("a", "b", F.round("d", 3).alias("d"))


@query("SELECT n_nationkey, to_base64(CAST(n_name AS BLOB)) AS coded, n_name AS plain FROM nation")
def base64_texts(spark, sf):
    coded = F.base64(F.encode(F.col("n_name"), "UTF-8"))
    return T(spark, sf, "nation").select("n_nationkey", coded.alias("coded"), F.unbase64(coded).cast("string").alias("plain"))


@query("SELECT count(*) AS n_rows, true AS same FROM orders")
def roundtrip_fingerprint(spark, sf):
    """A table written, read again, and held against itself by fingerprint."""
    columns = {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_orderpriority": "s", "o_totalprice": "d"}
    rows, path = T(spark, sf, "orders").select(*columns), f"{scratch(spark)}/orders"
    rows.write.parquet(path)
    back = spark.read.parquet(path)
    a, b = (V.fingerprint_table(t, columns) for t in (rows, back))
    return a.join(b.toDF("b_rows", "b_sha"), F.lit(True)).select("n_rows", ((F.col("n_rows") == F.col("b_rows")) & (F.col("sha") == F.col("b_sha"))).alias("same"))


@query("WITH w AS (SELECT p_partkey AS id, p_size * 0.5 AS area, p_retailprice / 100 AS aspect, p_partkey % 3 AS cause FROM part) SELECT id, area FROM w WHERE area >= 1 AND aspect >= 10 AND cause = 1")
def void_thresholds(spark, sf):
    """Voids that a report shows: large and long enough, of one cause."""
    k = F.col("p_partkey")
    w = T(spark, sf, "part").select(k.alias("id"), (F.col("p_size") * F.lit(0.5)).alias("area"), (F.col("p_retailprice") / 100).alias("aspect"), (k % 3).alias("cause"))
    return w.where("area >= 1 AND aspect >= 10 AND cause = 1").select("id", "area")
