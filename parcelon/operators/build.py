"""The build: records with boxes to zones, a table per code, enriched records and their summary.

Everything stays lazy; what the build must not pass over (a record without a box that needs one,
without a rule or with several zones; a code with two names; a text longer than its field) fails in
the column that carries the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fits_bytes
from .rules import attributes_match, has_bounds, split_boxes

BOX = ["xmin", "ymin", "xmax", "ymax"]
#: The fields that the build adds to a table, with their kinds and widths in bytes.
ADDED = {"ZONE": "N2", "ZONE_ROMAN": "C5", "EPSG": "N4", "UNIT_CODE": "C5", "UNIT_NAME": "C120"}


def to_attributes(records: DataFrame, names: dict[str, str]) -> DataFrame:
    """records with attribute columns from columns of other names; a column that is not there, and
    a null, is empty text."""
    made = [F.coalesce(F.col(source), F.lit("")).alias(target) if source in records.columns else F.lit("").alias(target) for target, source in names.items()]
    return records.select(*(c for c in records.columns if c not in names), *made)


def needs_box(rules: list[dict]) -> Column:
    tests = [attributes_match(r) for r in rules if has_bounds(r)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def fail(*parts: Column, kind: str = "int") -> Column:
    return F.raise_error(F.concat(*parts)).cast(kind)


def box_report(records: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """For each record (attributes, code, box): kinds (zones and, if a part has no rule, one more),
    sole, zones (sorted) and lines, as text like lat=28."""
    cells = split_boxes(records, rules)
    found = cells.groupBy(key).agg(F.countDistinct("zone").alias("d"), F.count("*").alias("n"), F.count("zone").alias("z"), F.min("zone").alias("sole"), F.array_sort(F.collect_set("zone")).alias("zones"), F.first("xs").alias("xs"), F.first("ys").alias("ys"))
    shown = lambda axis, c: F.transform(c, lambda v: F.concat(F.lit(f"{axis}="), plain_number(v)))
    return found.select(key, (F.col("d") + F.when(F.col("n") > F.col("z"), 1).otherwise(0)).alias("kinds"), "sole", "zones", F.concat(shown("lon", "xs"), shown("lat", "ys")).alias("lines"))


def plain_number(value: Column) -> Column:
    """Six significant digits, no trailing zeros: 28, 140.5."""
    return F.regexp_replace(F.regexp_replace(F.round(value, 6).cast("decimal(20,6)").cast("string"), r"0+$", ""), r"\.$", "")


def assign_zones(records: DataFrame, rules: list[dict], key: str = "rec") -> DataFrame:
    """records (attributes, code, box, deleted) with zone: null for deleted rows, and a failure for
    the others where no single zone can be told."""
    live = records.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in records.columns else records
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in BOX))
    named = lambda text: fail(F.lit("record "), F.col(key).cast("string"), F.lit(text))
    unboxed = F.when(~whole & needs_box(rules), True).otherwise(False)
    # A record without a box has one cell without a point, which the rules do not ask for.
    ready = live.withColumn("_unboxed", unboxed)
    report = box_report(ready.where("NOT _unboxed"), rules, key)
    told = ready.select(key, "_unboxed").join(report, key, "left")
    zone = (
        F.when(F.col("_unboxed"), named(" needs a box"))
        .when(F.col("kinds") > 1, fail(F.lit("record "), F.col(key).cast("string"), F.lit(" may cross into another zone: "), F.array_join(F.col("zones").cast("array<string>"), " ")))
        .when(F.col("sole").isNull(), named(" has no rule"))
        .otherwise(F.col("sole"))
    )
    return records.join(told.select(key, zone.alias("zone")), key, "left")


def key_table(records: DataFrame, code: str, names: list[str], zone: str = "zone") -> DataFrame:
    """code, names, zones (14;18;19), polygons: a row per code; fails if a code has two names."""
    live = records.where(F.col(zone).isNotNull())
    named = F.struct(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in names))
    found = live.groupBy(code).agg(F.min(named).alias("low"), F.max(named).alias("high"), F.array_sort(F.collect_set(zone)).alias("z"), F.count("*").alias("polygons"))
    broken = F.col("low") != F.col("high")
    told = lambda n: F.when(broken, fail(F.lit("two names for code "), F.col(code), kind="string")).otherwise(F.col(f"low.{n}")).alias(n)
    return found.select(code, *map(told, names), F.array_join(F.col("z").cast("array<string>"), ";").alias("zones"), "polygons")


def unit_code(prefecture: Column, code: Column, split: list[str]) -> Column:
    return F.when(prefecture.isin(split), code).otherwise(F.concat(F.substring(code, 1, 2), F.lit("000")))


def enriched(records: DataFrame, zones: DataFrame, split: list[str], columns: dict[str, str]) -> DataFrame:
    """records with the ADDED fields as text, ZONE in place of zone; empty for rows without one. `zones` is the zone
    dimension, `split` the prefectures whose units are municipalities, `columns` names the columns
    for prefecture, municipality, ward and code."""
    at = {k: F.coalesce(F.col(v), F.lit("")) if v in records.columns else F.lit("") for k, v in columns.items()}
    dimension = zones.select(F.col("zone").alias("_z"), "zone_roman", "epsg")
    joined = records.join(F.broadcast(dimension) if zones.count() <= 1000 else dimension, F.col("zone") == F.col("_z"), "left")
    name = F.when(at["prefecture"].isin(split), F.concat(at["municipality"], at["ward"])).otherwise(at["prefecture"])
    values = {"ZONE": F.col("zone").cast("string"), "ZONE_ROMAN": F.col("zone_roman"), "EPSG": F.col("epsg"), "UNIT_CODE": unit_code(at["prefecture"], at["code"], split), "UNIT_NAME": name}
    shown = lambda n, v: F.when(F.col("zone").isNull(), "").otherwise(fits_bytes(v, int(ADDED[n][1:]))).alias(n)
    return joined.select(*(F.col(c) for c in records.columns if c.upper() not in ADDED), *(shown(n, v) for n, v in values.items()))


def dissolve_keys(records: DataFrame, level: str, columns: dict[str, str], split: list[str], zone: str = "zone") -> DataFrame:
    """The distinct keys that a dissolve at a level gives; a level of another name fails."""
    live, code = records.where(F.col(zone).isNotNull()), F.col(columns["code"])
    keys = {"zone": F.lit(""), "unit": unit_code(F.col(columns["prefecture"]), code, split), "municipality": code}
    if level not in keys:
        raise ValueError(f"no such level: {level}")
    return live.select(keys[level].alias("key"), zone).distinct()


def summary(records: DataFrame, table: DataFrame, columns: dict[str, str], split: list[str]) -> DataFrame:
    """item, value: polygons, codes, polygons of each zone, split codes, dissolved features per level."""
    live = records.where(F.col("zone").isNotNull())
    one = lambda item, rows: rows.agg(F.lit(item).alias("item"), F.count("*").alias("value"))
    parts = [one("polygons", live), one("codes", table), one("split codes", table.where(F.col("zones").contains(";")))]
    parts.append(live.groupBy(F.concat(F.lit("zone "), F.col("zone").cast("string")).alias("item")).agg(F.count("*").alias("value")))
    parts += [one(f"dissolved by {level}", dissolve_keys(records, level, columns, split)) for level in ("zone", "unit", "municipality")]
    return reduce(DataFrame.union, parts)
