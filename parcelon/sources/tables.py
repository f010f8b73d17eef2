"""Dimensions in CSV files, with explicit schemas: rules and zones."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null
from ..operators.rules import ATTRIBUTES, BOUNDS

#: Rules that a CASE chain is compiled from; longer tables are for classify_join.
MOST_RULES = 2000


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark is skipped, blanks are empty text."""
    found = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", mode="FAILFAST")
    return found.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("\ufeff").strip()) for c in found.columns))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, zone, the attributes and the code (trimmed), the bounds (null where blank); fails on a
    bound that is no number."""
    rows = csv_text(spark, path)
    text = [F.trim(F.col(c)).alias(c) for c in [*ATTRIBUTES, "code"]]
    return rows.select(F.col("rule_id").cast("int").alias("rule_id"), F.col("zone").cast("int").alias("zone"), *text, *(blank_to_null(F.col(c)).alias(c) for c in BOUNDS))


def load_rules(spark: SparkSession, path: str, most: int = MOST_RULES) -> list[dict]:
    """The rules in their order, for classify(); a table of more than `most` rules fails."""
    rows = read_rules(spark, path).orderBy("rule_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules: use read_rules and classify_join")
    return [r.asDict() for r in rows]


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """zone, zone_roman, epsg and what other columns the file has."""
    rows = csv_text(spark, path)
    rest = [c for c in rows.columns if c not in ("zone", "epsg_jgd2011")]
    return rows.select(F.col("zone").cast("int").alias("zone"), *rest, F.col("epsg_jgd2011").alias("epsg"))


def input_error(path: str) -> str | None:
    """What is wrong with the path of a shapefile, or None: its kind, its being there, its table."""
    stem, kind = os.path.splitext(path.removeprefix("file://"))
    if kind.lower() == ".dbf":
        return f"name the .shp, not its table: {stem}.shp"
    if kind.lower() != ".shp":
        return f"not a shapefile: {path}"
    if not os.path.isfile(stem + kind):
        return f"no such file: {path}"
    if not os.path.isfile(stem + (".DBF" if kind == ".SHP" else ".dbf")):
        return f"its table is missing: {stem}.dbf"
    return None
