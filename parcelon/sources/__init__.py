"""Readers of files: register(spark) makes the formats "dbf", "shp" and "gpkg" known to a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dbase import DbfSource
from .geopackage import GpkgSource
from .shapefile import ShpSource


def register(spark: SparkSession) -> None:
    for source in (DbfSource, ShpSource, GpkgSource):
        spark.dataSource.register(source)


def positional_join(attributes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Joins by rec, the place in the file; fails if one side has a place that the other lacks.

    Read the attributes with deleted = keep, or deleted rows count as missing.
    """
    a, b = attributes.withColumn("_a", F.lit(True)), shapes.withColumn("_b", F.lit(True))
    joined = a.join(b, "rec", "full_outer")
    whole = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("record counts differ")).cast("long")).otherwise(F.col("rec"))
    return joined.withColumn("rec", whole).drop("_a", "_b")
