"""Exact dedup by an extendible-hash index on shared files (DataFrame operations only).

The index holds one entry per distinct key, also of keys that occur once. A directory maps the
leading bits of the 64-bit hash to buckets; it doubles while a bucket is overfull, and only overfull
buckets split, so a bucket has a local depth of its own. Owner tasks take ranges of the hash that
are runs of whole buckets, and write them to files sorted by bucket and hash. Entries of one hash
form a chain, in which texts are told apart by comparing their bytes. A row is looked up by the slot
of its hash, the slot's bucket, the chain of its hash there and its place in the chain.

Skew: the rows of a large group of copies are pre-aggregated before each shuffle, and the rows
themselves meet their group in a join whose large partitions Spark can split.

Defined cases: a null text is the empty text and empty texts equal each other; a text of any length
is hashed and compared whole; rows with a null doc_id take part, and stay only in a group without
any doc_id; rows that repeat both doc_id and text are one document, so all of them report kept (with
`row`, one of them does); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, parts_for, shared_dir, table, text_of, written

#: Entries that a bucket holds before it splits.
BUCKET_ENTRIES = 4096
#: Bits beyond the expected depth for which loads are counted at a time.
SPARE_BITS = 6
#: A directory can tell all bits of the hash apart; entries that share all of them are one chain.
HASH_BITS = 64


def slot(h: Column, bits: int) -> Column:
    """The leading bits of a hash; signed order is kept, so slots are runs of the hash order."""
    return F.shiftright(h, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def build_directory(entries: DataFrame, folder: str, capacity: int = BUCKET_ENTRIES) -> tuple[DataFrame, int]:
    """The directory (slot, bucket, depth) and its global depth.

    `entries` has a row per distinct key, with its hash h. The directory starts at the depth that
    the number of entries asks for and doubles until no bucket is overfull; a bucket's number is
    that of its first slot.
    """
    total = entries.count()
    depth = max(1, math.ceil(math.log2(max(2, total / capacity))))
    most, cells, buckets = 0, None, None
    while True:
        if depth > most:  # the loads of all slots, counted SPARE_BITS ahead
            most = min(HASH_BITS, depth + SPARE_BITS)
            cells = written(entries.groupBy(slot(F.col("h"), most).alias("cell")).agg(F.count("*").alias("load")), folder, f"cells-{most}")
        level = cells.groupBy(F.shiftright("cell", most - depth).alias("slot")).agg(F.sum("load").alias("load"))
        if buckets is None:
            buckets = level.select("slot", F.col("slot").alias("bucket"), F.lit(depth).alias("depth"), "load")
        else:
            # Buckets that fit keep their depth and now have two slots; overfull ones split.
            old = buckets.select(F.col("slot").alias("parent"), "bucket", F.col("depth").alias("was"), F.col("load").alias("held"))
            split = F.col("held") > capacity
            buckets = (
                level.withColumn("parent", F.shiftright("slot", 1))
                .join(old, "parent")
                .select(
                    "slot",
                    F.when(split, F.col("slot")).otherwise(F.shiftleft("bucket", 1)).alias("bucket"),
                    F.when(split, F.lit(depth)).otherwise(F.col("was")).alias("depth"),
                    F.when(split, F.col("load")).otherwise(F.col("held")).alias("load"),
                )
            )
        buckets = written(buckets, folder, f"directory-{depth}")
        if depth == HASH_BITS or not buckets.where(F.col("load") > capacity).head(1):
            return buckets.select("slot", "bucket", "depth"), depth
        depth += 1


def build_index(entries: DataFrame, directory: DataFrame, depth: int, folder: str) -> DataFrame:
    """The bucket files: bucket, h, chain (place in the chain of h), and the columns of entries."""
    spark = entries.sparkSession
    placed = entries.withColumn("slot", slot(F.col("h"), depth)).join(directory.select("slot", "bucket"), "slot").drop("slot")
    owners = parts_for(entries.count(), 64 * BUCKET_ENTRIES, least=int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Cut by bucket: an owner has a run of whole buckets, and so a range of the hash.
    owned = placed.repartitionByRange(owners, "bucket").withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha")))
    return written(owned.sortWithinPartitions("bucket", "h", "chain"), folder, "buckets")


def exact_dedup(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (see the module). With `row`, a column
    that numbers the rows, the result has it too, as "row", and one row of each group is kept: of
    those with the largest key the one with the largest number."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    number = F.lit(0).cast("long") if row is None else F.col(row).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), number.alias("row"), ascii_lower(text_of(text)).alias("norm"))
    hashed = rows.withColumn("h", F.xxhash64("norm"))
    keys = written(hashed.select("doc_id", "row", "h", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha")), folder, "keys")
    best, many = F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")

    # Grouping by the text itself compares bytes, so that a chain has an entry for each text of its
    # hash. Copies are combined before the shuffle, which moves each distinct text, at every size alike.
    entries = hashed.groupBy("h", "norm").agg(best, many).select("h", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "best", "group_size")
    entries = written(entries, folder, "entries")

    directory, depth = build_directory(entries.select("h"), folder)
    index = build_index(entries, directory, depth, folder)

    asked = keys.withColumn("slot", slot(F.col("h"), depth)).join(directory.select("slot", "bucket"), "slot")
    chains = index.select(F.col("bucket").alias("in"), F.col("h").alias("eh"), F.col("sha").alias("esha"), "best", "group_size")
    # A merge join at every size: the entries grow with the input.
    found = asked.join(chains.hint("merge"), (F.col("bucket") == F.col("in")) & (F.col("h") == F.col("eh")) & (F.col("sha") == F.col("esha")))
    keep = F.col("best.doc_id")
    kept = F.col("doc_id").eqNullSafe(keep) if row is None else F.col("row") == F.col("best.row")
    result = [F.col("doc_id"), keep.alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    return found.select(*result, *([] if row is None else ["row"]))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
