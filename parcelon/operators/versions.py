"""Comparing two versions of a keyed table, and fingerprints of tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of only one side: key, side."""
    a, b = old.select(key).distinct().withColumn("o", F.lit(1)), new.select(key).distinct().withColumn("n", F.lit(1))
    both = a.join(b, key, "full_outer").where("o IS NULL OR n IS NULL")
    return both.select(key, F.when(F.col("o").isNull(), "new").otherwise("old").alias("side"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that fails if a key repeats on either side."""
    for side, name in ((left, "left"), (right, "right")):
        if side.groupBy(*keys).count().where("count > 1").head(1):
            raise ValueError(f"a key repeats on the {name} side")
    return left.join(right, keys, "left")


def tagged(column: Column, tag: str) -> Column:
    """A value with its type's tag and its length, so that no two rows look alike by accident."""
    text = F.hex(column) if tag.startswith("binary") else column.cast("string")
    return F.when(column.isNull(), F.lit("n;")).otherwise(F.concat(F.lit(tag), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def row_hashes(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    return table.select(F.sha2(F.concat(*(tagged(F.col(c), t) for c, t in columns.items())), 256).alias("h"))


def fingerprint_table(table: DataFrame, columns: dict[str, str], rows: int = 100_000) -> DataFrame:
    """n_rows and sha as of a multiset, for tables of any size: rows are counted per hash, so that
    copies are one row, and the hashes' leading digits make as many parts as keep each below `rows`."""
    hashes = row_hashes(table, columns).groupBy("h").agg(F.count("*").alias("k"))
    digits = max(1, math.ceil(math.log(max(2, hashes.count() / rows), 16)))
    entry = F.concat("h", F.lit(":"), F.col("k").cast("string"))
    parts = hashes.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sum("k").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ","), 256).alias("h"))
    while digits > 4:  # parts of parts, four digits at a time
        digits -= 4
        parts = parts.groupBy(F.substring("p", 1, digits).alias("q")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda s: s["h"]), ""), 256).alias("h")).withColumnRenamed("q", "p")
    return parts.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda s: s["h"]), ""), 256).alias("sha"))


def fingerprint(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Multiset fingerprint: hashes of rows are counted per leading byte first, so that no task
    gathers more than a 256th part of them; then the parts are hashed in order. Beyond some million
    rows, fingerprint_table() takes as many parts as the rows need."""
    parts = row_hashes(table, columns).groupBy(F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda s: s["h"]), ""), 256).alias("sha"))


def compare_layers(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of same_* flags: the schemas, the number of rows, and multiset fingerprints of all
    columns, of all but the key, of the key, and of each attribute. Where a column's type differs
    or one side lacks it, the flags that need it are false."""
    types = [dict(t.dtypes) for t in (left, right)]

    def same(columns: set[str]) -> Column:
        if any(types[0].get(c) != types[1].get(c) for c in columns):
            return F.lit(False)
        tags = {c: types[0][c] + ":" for c in sorted(columns)}
        a, b = (fingerprint(t, tags).select(F.struct(F.coalesce("n_rows", F.lit(0)), "sha").alias("f")) for t in (left, right))
        return a.scalar().eqNullSafe(b.scalar())

    every = set(types[0]) | set(types[1])
    flags = {"same_schema": F.lit(sorted(types[0].items()) == sorted(types[1].items()))}
    flags["same_count"] = left.agg(F.count("*")).scalar() == right.agg(F.count("*")).scalar()
    flags |= {"same_values": same(every), "same_attributes": same(every - {key}), "same_keys": same({key})}
    flags |= {f"same_{c}": same({c}) for c in sorted(every - {key})}
    return left.sparkSession.range(1).select(*(v.alias(k) for k, v in flags.items()))
