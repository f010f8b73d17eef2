"""Geometry and attributes made from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geometry as G


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the fixture.
RULES = [
    dict(rule_id=1, zone=1, prefecture="ASIA", county="BUILDING", lon_min=20.0, lon_max=60.0, lat_min=10.0, lat_max=50.0),
    dict(rule_id=2, zone=2, prefecture="ASIA", municipality="NATION_12", code="00012"),
    dict(rule_id=3, zone=3, prefecture="ASIA", county="MACHINERY"),
    dict(rule_id=4, zone=4, prefecture="ASIA", lat_max=30.0),
    dict(rule_id=5, zone=5, prefecture="ASIA"),
    dict(rule_id=6, zone=6, prefecture="EUROPE", lon_min=90.0),
    dict(rule_id=7, zone=7, prefecture="EUROPE", county="AUTOMOBILE", lat_min=45.0),
    dict(rule_id=8, zone=8, prefecture="EUROPE"),
    dict(rule_id=9, zone=9, prefecture="AFRICA", code="00005"),
    dict(rule_id=10, zone=10, prefecture="AFRICA", lon_max=120.0, lat_max=60.0),
    dict(rule_id=11, zone=11, county="HOUSEHOLD"),
    dict(rule_id=12, zone=12, prefecture="AMERICA"),
]
FIELDS = ["rule_id", "zone", "prefecture", "subprefecture", "county", "municipality", "code", "lon_min", "lon_max", "lat_min", "lat_max"]


def rules_frame(spark: SparkSession) -> DataFrame:
    rows = [tuple(r.get(f, "" if f in FIELDS[2:7] else None) for f in FIELDS) for r in RULES]
    return spark.createDataFrame(rows, "rule_id int, zone int, prefecture string, subprefecture string, county string, municipality string, code string, lon_min double, lon_max double, lat_min double, lat_max double")


def _sql(v) -> str:
    return "NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def rules_sql(rules: list[dict]) -> str:
    return "rules(" + ", ".join(FIELDS) + ") AS (VALUES " + ", ".join("(" + ", ".join(_sql(r.get(f, "" if f in FIELDS[2:7] else None)) for f in FIELDS) + ")" for r in rules) + ")"


RULES_SQL = rules_sql(RULES)

RECORDS_SQL = """records AS (SELECT c_custkey AS id, r_name AS prefecture, '' AS subprefecture, c_mktsegment AS county, n_name AS municipality,
  lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, CAST(c_custkey * 7 % 180 AS DOUBLE) AS lon, CAST(c_custkey * 11 % 90 AS DOUBLE) AS lat
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MATCH_SQL = """(r.prefecture = '' OR r.prefecture = a.prefecture) AND (r.county = '' OR r.county = a.county) AND (r.municipality = '' OR r.municipality = a.municipality) AND (r.code = '' OR r.code = a.code)"""
BOUND_SQL = """(r.lon_min IS NULL OR a.lon >= r.lon_min) AND (r.lon_max IS NULL OR a.lon <= r.lon_max) AND (r.lat_min IS NULL OR a.lat >= r.lat_min) AND (r.lat_max IS NULL OR a.lat <= r.lat_max)"""
ZONED_SQL = f"WITH {RULES_SQL}, {RECORDS_SQL}, zoned AS (SELECT a.*, (SELECT arg_min(r.zone, r.rule_id) FROM rules r WHERE {MATCH_SQL} AND {BOUND_SQL}) AS zone FROM records a)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records: region, nation and segment as attributes, a point from the key."""
    c, n, r = (T(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    found = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return found.select(F.col("c_custkey").alias("id"), F.col("r_name").alias("prefecture"), F.lit("").alias("subprefecture"), F.col("c_mktsegment").alias("county"), F.col("n_name").alias("municipality"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code"), (F.col("c_custkey") * 7 % 180).cast("double").alias("lon"), (F.col("c_custkey") * 11 % 90).cast("double").alias("lat"))


VERTICES_SQL = """v0 AS (SELECT l_orderkey AS ring, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  130 + l_quantity / 10 AS x, 30 + 50 * l_discount + 10 * l_tax AS y, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
v AS (SELECT ring, CAST(seq AS INTEGER) AS seq, x, y FROM v0 WHERE n >= 3)"""
SEGMENTS_SQL = VERTICES_SQL + """,
s AS (SELECT ring, seq, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM v WINDOW w AS (PARTITION BY ring ORDER BY seq))"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the vertices of a ring."""
    # Named before the windows: Spark takes a name given beside them for another column and shuffles again by it.
    lines = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ring"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (130 + F.col("l_quantity") / 10).alias("x"), (30 + 50 * F.col("l_discount") + 10 * F.col("l_tax")).alias("y"))
    part = Window.partitionBy("ring")
    order = part.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = lines.select("ring", F.row_number().over(order).alias("seq"), "x", "y", F.count("*").over(part).alias("n"))
    return rows.where("n >= 3").drop("n")


def ring_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.segments(vertices(spark, sf_dir))


BOXES_SQL = """box AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 1000 AS DOUBLE) / 10 AS xmin, CAST(p_partkey * 53 % 990 AS DOUBLE) / 10 AS ymin,
  CAST(p_partkey * 37 % 1000 AS DOUBLE) / 10 + p_size / 40.0 AS xmax, CAST(p_partkey * 53 % 990 AS DOUBLE) / 10 + p_size / 50.0 AS ymax, p_brand AS brand FROM part)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("p_partkey") * 37 % 1000).cast("double") / 10, (F.col("p_partkey") * 53 % 990).cast("double") / 10
    return T(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.alias("xmin"), y.alias("ymin"), (x + F.col("p_size") / 40.0).alias("xmax"), (y + F.col("p_size") / 50.0).alias("ymax"), F.col("p_brand").alias("brand"))


POINTS_SQL = """pa AS (SELECT c_custkey AS id, CAST(c_custkey * 379 % 10007 AS DOUBLE) / 50 AS x, CAST(c_custkey * 733 % 10009 AS DOUBLE) / 50 AS y FROM customer),
pb AS (SELECT s_suppkey AS b_id, CAST(s_suppkey * 4591 % 10007 AS DOUBLE) / 50 AS qx, CAST(s_suppkey * 7919 % 10009 AS DOUBLE) / 50 AS qy FROM supplier)"""


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = F.col("c_custkey"), F.col("s_suppkey")
    return (
        T(spark, sf_dir, "customer").select(a.alias("id"), ((a * 379 % 10007).cast("double") / 50).alias("x"), ((a * 733 % 10009).cast("double") / 50).alias("y")),
        T(spark, sf_dir, "supplier").select(b.alias("b_id"), ((b * 4591 % 10007).cast("double") / 50).alias("bx"), ((b * 7919 % 10009).cast("double") / 50).alias("by")),
    )
