"""Queries on rule classification, key-level tables and their dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources
from ..operators import rules as R
from .fixtures import BOUND_SQL, MATCH_SQL, RECORDS_SQL, RULES, RULES_SQL, ZONED_SQL, T, boxes, records, rules_frame
from .fixtures import BOXES_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def zoned(spark, sf):
    return R.classify(records(spark, sf), RULES)


@query(ZONED_SQL + " SELECT id, zone FROM zoned")
def rule_classify(spark, sf):
    return zoned(spark, sf).select("id", "zone")


@query(ZONED_SQL + " SELECT id, zone FROM zoned")
def rule_classify_join(spark, sf):
    return R.classify_join(records(spark, sf), rules_frame(spark), "id")


@query(ZONED_SQL + """ SELECT code, min(prefecture) AS prefecture, min(municipality) AS municipality, string_agg(DISTINCT CAST(zone AS VARCHAR), ';' ORDER BY CAST(zone AS VARCHAR)) AS zones, count(*) AS polygons
FROM zoned GROUP BY code""")
def key_zone_table(spark, sf):
    """One row per code: names, the sorted list of its zones, the number of records."""
    found = zoned(spark, sf).groupBy("code").agg(F.min("prefecture").alias("prefecture"), F.min("municipality").alias("municipality"), F.array_sort(F.collect_set(F.col("zone").cast("string"))).alias("z"), F.count("*").alias("polygons"))
    return found.select("code", "prefecture", "municipality", F.when(F.size("z") > 0, F.array_join("z", ";")).alias("zones"), "polygons")


@query(ZONED_SQL + " SELECT zone, count(*) AS n, count(DISTINCT code) AS codes FROM zoned GROUP BY zone")
def zone_counts(spark, sf):
    return zoned(spark, sf).groupBy("zone").agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"))


@query(ZONED_SQL + " SELECT code, count(DISTINCT zone) AS zones FROM zoned GROUP BY code HAVING count(DISTINCT zone) > 1")
def split_keys(spark, sf):
    return zoned(spark, sf).groupBy("code").agg(F.countDistinct("zone").alias("zones")).where("zones > 1")


@query(ZONED_SQL + " SELECT 'unit' AS level, count(DISTINCT (zone, prefecture)) AS n FROM zoned UNION ALL SELECT 'municipality', count(DISTINCT (zone, code)) FROM zoned")
def dissolve_keys(spark, sf):
    z = zoned(spark, sf)
    count = lambda level, *c: z.select("zone", *c).distinct().agg(F.lit(level).alias("level"), F.count("*").alias("n"))
    return count("unit", "prefecture").union(count("municipality", "code"))


@query(f"WITH {RECORDS_SQL} SELECT code, count(DISTINCT municipality) AS names, count(DISTINCT municipality) = 1 AS holds FROM records GROUP BY code")
def fd_check(spark, sf):
    """Functional dependency: one name for each code."""
    found = records(spark, sf).groupBy("code").agg(F.countDistinct("municipality").alias("names"))
    return found.withColumn("holds", F.col("names") == 1)


@query(f"""WITH {RECORDS_SQL} SELECT id, CASE WHEN prefecture IN ('ASIA', 'EUROPE') THEN code ELSE substr(code, 1, 2) || '000' END AS unit_code,
CASE WHEN prefecture IN ('ASIA', 'EUROPE') THEN municipality || county ELSE prefecture END AS unit_name FROM records""")
def unit_key(spark, sf):
    """Some prefectures keep the code and the joined name; others fall to the prefecture's."""
    own = F.col("prefecture").isin("ASIA", "EUROPE")
    return records(spark, sf).select("id", F.when(own, F.col("code")).otherwise(F.concat(F.substring("code", 1, 2), F.lit("000"))).alias("unit_code"), F.when(own, F.concat("municipality", "county")).otherwise(F.col("prefecture")).alias("unit_name"))


@query(f"WITH {RECORDS_SQL} SELECT id, coalesce(nullif(CASE WHEN county = 'BUILDING' THEN '' ELSE county END, ''), municipality) AS unit_name FROM records")
def unit_key_alt(spark, sf):
    ward = F.when(F.col("county") == "BUILDING", "").otherwise(F.col("county"))
    return records(spark, sf).select("id", F.coalesce(F.nullif(ward, F.lit("")), F.col("municipality")).alias("unit_name"))


@query(ZONED_SQL + ", dim AS (SELECT CAST(range AS INTEGER) AS zone, 'Z' || lpad(CAST(range AS VARCHAR), 2, '0') AS roman, CAST(6668 + range AS INTEGER) AS epsg FROM range(1, 13)) SELECT id, coalesce(roman, '') AS roman, coalesce(CAST(epsg AS VARCHAR), '') AS epsg FROM zoned LEFT JOIN dim USING (zone)")
def zone_enrich(spark, sf):
    dim = spark.range(1, 13).select(F.col("id").cast("int").alias("zone"), F.concat(F.lit("Z"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("roman"), (F.col("id") + 6668).cast("string").alias("epsg"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return zoned(spark, sf).join(F.broadcast(dim), "zone", "left").select("id", blank("roman"), blank("epsg"))


@query(f"WITH {RECORDS_SQL} SELECT DISTINCT prefecture, municipality, code FROM records")
def keep_fields(spark, sf):
    return records(spark, sf).select("prefecture", "municipality", "code").distinct()


_AB = f"""WITH {RULES_SQL}, {BOXES_SQL},
b AS (SELECT id, xmin, ymin, xmax + 20 AS xmax, ymax + 12 AS ymax, CASE WHEN id % 2 = 0 THEN 'ASIA' ELSE 'EUROPE' END AS prefecture, '' AS county, '' AS municipality, '' AS code FROM box),
l AS (SELECT a.id, 'lon' AS axis, unnest([r.lon_min, r.lon_max]) AS v, a.xmin AS lo, a.xmax AS hi FROM b a JOIN rules r ON {MATCH_SQL}
 UNION ALL SELECT a.id, 'lat', unnest([r.lat_min, r.lat_max]), a.ymin, a.ymax FROM b a JOIN rules r ON {MATCH_SQL}),
lines AS (SELECT DISTINCT id, axis, v FROM l WHERE v > lo AND v < hi),"""
_CELLS = _AB + f"""
ex AS (SELECT id, v FROM lines WHERE axis = 'lon' UNION ALL SELECT id, xmin FROM b UNION ALL SELECT id, xmax FROM b),
ey AS (SELECT id, v FROM lines WHERE axis = 'lat' UNION ALL SELECT id, ymin FROM b UNION ALL SELECT id, ymax FROM b),
mx AS (SELECT id, (v + lead(v) OVER (PARTITION BY id ORDER BY v)) / 2 AS lon FROM ex), my AS (SELECT id, (v + lead(v) OVER (PARTITION BY id ORDER BY v)) / 2 AS lat FROM ey),
a AS (SELECT b.*, lon, lat FROM b JOIN mx USING (id) JOIN my USING (id) WHERE lon IS NOT NULL AND lat IS NOT NULL),
z AS (SELECT a.*, (SELECT arg_min(r.zone, r.rule_id) FROM rules r WHERE {MATCH_SQL} AND {BOUND_SQL}) AS zone FROM a),
g AS (SELECT id, min(prefecture) AS prefecture, count(DISTINCT zone) + CASE WHEN count(*) > count(zone) THEN 1 ELSE 0 END AS kinds, min(zone) AS sole, string_agg(DISTINCT lpad(CAST(zone AS VARCHAR), 2, '0'), ' ' ORDER BY lpad(CAST(zone AS VARCHAR), 2, '0')) AS zones FROM z GROUP BY id)"""


def rule_boxes(spark, sf):
    made = boxes(spark, sf).withColumn("xmax", F.col("xmax") + 20).withColumn("ymax", F.col("ymax") + 12)
    return made.select("id", "xmin", "ymin", "xmax", "ymax", F.when(F.col("id") % 2 == 0, "ASIA").otherwise("EUROPE").alias("prefecture"), *(F.lit("").alias(c) for c in ("subprefecture", "county", "municipality", "code")))


def free_rules():
    """Rules whose attributes can match boxes without county, municipality and code."""
    return [r for r in RULES if not any(r.get(f) for f in ("county", "municipality", "code"))]


def box_cells(spark, sf):
    return R.split_boxes(rule_boxes(spark, sf), free_rules())


def box_zones(spark, sf):
    found = box_cells(spark, sf).groupBy("id").agg(F.min("prefecture").alias("prefecture"), F.countDistinct("zone").alias("d"), F.count("*").alias("n"), F.count("zone").alias("nz"), F.min("zone").alias("sole"), F.array_sort(F.collect_set(F.lpad(F.col("zone").cast("string"), 2, "0"))).alias("z"), F.first("xs").alias("xs"), F.first("ys").alias("ys"))
    return found.withColumn("kinds", F.col("d") + F.when(F.col("n") > F.col("nz"), 1).otherwise(0))


@query(_AB[:-1] + " SELECT id, axis, v AS line FROM lines")
def box_lines(spark, sf):
    cut = box_cells(spark, sf).select("id", "xs", "ys").distinct()
    lines = lambda axis, c: cut.select("id", F.lit(axis).alias("axis"), F.explode(c).alias("line"))
    return lines("lon", "xs").union(lines("lat", "ys"))


@query(_CELLS + " SELECT id, kinds > 1 AS crosses, CASE WHEN kinds > 1 THEN '' ELSE coalesce(CAST(sole AS VARCHAR), '') END AS zone, CASE WHEN kinds > 1 THEN coalesce(zones, '') ELSE '' END AS zones FROM g")
def box_split(spark, sf):
    """The report: crossing boxes list their zones and have no zone of their own."""
    crosses = F.col("kinds") > 1
    return box_zones(spark, sf).select("id", crosses.alias("crosses"), F.when(crosses, "").otherwise(F.coalesce(F.col("sole").cast("string"), F.lit(""))).alias("zone"), F.when(crosses, F.array_join("z", " ")).otherwise("").alias("zones"))


@query(_CELLS + " SELECT id, sole AS zone, CASE WHEN kinds > 1 THEN 'crosses' WHEN sole IS NULL THEN 'no rule' ELSE 'ok' END AS status FROM g")
def assign_zones(spark, sf):
    """The build's twin: what it would fail on is a status here."""
    return box_zones(spark, sf).select("id", F.col("sole").alias("zone"), F.when(F.col("kinds") > 1, "crosses").when(F.col("sole").isNull(), "no rule").otherwise("ok").alias("status"))


@query(_CELLS + " SELECT prefecture, CASE WHEN kinds > 1 THEN 'crossing' ELSE coalesce(CAST(sole AS VARCHAR), 'none') END AS bucket, count(*) AS n FROM g GROUP BY ALL")
def crossing_summary(spark, sf):
    bucket = F.when(F.col("kinds") > 1, "crossing").otherwise(F.coalesce(F.col("sole").cast("string"), F.lit("none")))
    return box_zones(spark, sf).groupBy("prefecture", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {BOXES_SQL}, a AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS rec, p_name AS name FROM part), b AS (SELECT row_number() OVER (ORDER BY id) - 1 AS rec, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax FROM box) SELECT rec, name, xmin, ymax FROM a JOIN b USING (rec)")
def positional_join(spark, sf):
    """Attributes and shapes by their place, which sources give and here a total order does; a place
    that one side lacks fails."""
    a = placed(T(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    b = placed(boxes(spark, sf).select("id", F.round("xmin", 6).alias("xmin"), F.round("ymax", 6).alias("ymax")))
    return sources.positional_join(a.drop("id"), b.drop("id")).select("rec", "name", "xmin", "ymax")


def placed(rows):
    """rec, the place in the order of id: places before each range of ids, then within the range."""
    t = rows.withColumn("r", F.floor(F.col("id") / 4096))
    base = t.groupBy("r").agg(F.count("*").alias("n"))
    base = base.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("r").orderBy("id")) - 1 + F.col("base")
    return t.join(base, "r").withColumn("rec", place.cast("long")).drop("r", "base")


@query("SELECT substr(lpad(CAST(o_custkey AS VARCHAR), 6, '0'), 1, 5) || '0' AS prefix, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def prefix_rollup(spark, sf):
    key = F.concat(F.substring(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), 1, 5), F.lit("0"))
    return T(spark, sf, "orders").groupBy(key.alias("prefix")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT event_type AS flag, count(*) AS n FROM events GROUP BY 1")
def flag_counts(spark, sf):
    return T(spark, sf, "events").groupBy(F.col("event_type").alias("flag")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(floor((value - 180.0 * floor(value / 180.0)) / 360 * 1024 + 512) AS BIGINT) AS tx,
CAST(floor((1 - asinh(tan(radians(event_id % 160 - 80.0))) / pi()) / 2 * 1024) AS BIGINT) AS ty FROM events""")
def tile_xy(spark, sf):
    """Tile of a longitude and latitude at zoom 10."""
    lon, lat = F.col("value") - 180.0 * F.floor(F.col("value") / 180.0), F.col("event_id") % 160 - 80.0
    return T(spark, sf, "events").select("event_id", F.floor(lon / 360 * 1024 + 512).cast("long").alias("tx"), F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * 1024).cast("long").alias("ty"))
