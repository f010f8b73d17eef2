"""Helpers that the operators share: the shared folder, written tables, text columns."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the
    session's JVM ends.

    Where that setting is missing, local mode takes a temporary folder of its own; a cluster has no
    folder that all of its machines would see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="parcelon-"))
        base = _local[0]
    folder = f"{base.rstrip('/')}/parcelon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/work"


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, folder: str, row: str = "row") -> DataFrame:
    """docs as a written table with a number for each row: once in files, a number stays with its
    row, whatever runs again. It tells rows apart that share an id, or have none."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), folder, "numbered")


def running_total(parts: DataFrame, order: str, value: str, total: str, folder: str, name: str, rows: int = 500_000) -> DataFrame:
    """parts with the sum of the values of all rows before, in ascending order of a column that has
    no value twice. Ranges of the order are summed first, in files that fix which row lies in which
    range; the one task that orders the ranges reads a row for each of them."""
    ranges = parts.repartitionByRange(parts_for(parts.count(), rows), order).withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, folder, name)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("_range").agg(F.sum(value).alias("_sum"))
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(ahead(Window.orderBy("_range"))), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(value).over(ahead(Window.partitionBy("_range").orderBy(order))), F.lit(0))
    return ranges.withColumn("_own", own).join(sums, "_range").withColumn(total, F.col("_base") + F.col("_own")).drop("_range", "_own", "_base")


def written(df: DataFrame, folder: str, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts the lineage."""
    path = f"{folder}/{name}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, folder: str, name: str, column: str, buckets: int, codec: str = "uncompressed") -> DataFrame:
    """As written(), in buckets of a column: a join on it leaves these rows where they are. Only
    the files stay: the result knows them, so the catalog's entry goes at once."""
    title, spark = f"parcelon_{name}_{uuid.uuid4().hex}", df.sparkSession
    df.write.option("compression", codec).option("path", f"{folder}/{name}").bucketBy(buckets, column).format("parquet").saveAsTable(title)
    found = spark.table(title)
    spark.sql(f"DROP TABLE {title}")
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() has a fast path for texts that are ASCII throughout."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def parts_for(total: int | float, target: int | float, least: int = 1) -> int:
    """Partitions so that each holds about `target` of `total`."""
    return max(least, int(-(-(total or 0) // target)))
