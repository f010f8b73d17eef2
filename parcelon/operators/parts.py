"""Parts of polygon records: rings become shells with their holes, and exteriors get fingerprints.

A record is one row that holds its rings, so parts are found within the row: nothing is shuffled,
and a record's rings meet the shells of that record only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of the shortest closed ring.
SHORTEST = 4


def _pairs(points: Column, f) -> Column:
    """f of every segment of a closed ring."""
    n = F.size(points) - 1
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), f)


def signed_area(points: Column) -> Column:
    """Planar area of a closed ring (array of x, y), above 0 if it runs counterclockwise. The sum starts
    at the first vertex, so that the sign of a small ring far from the origin is right."""
    x, y = points[0]["x"], points[0]["y"]
    part = lambda a, b: (a["x"] - x) * (b["y"] - y) - (b["x"] - x) * (a["y"] - y)
    return F.aggregate(_pairs(points, part), F.lit(0.0), lambda s, v: s + v) / 2


def holds(points: Column, x: Column, y: Column) -> Column:
    """The place is inside a closed ring; a place on the ring is not."""

    def passed(a: Column, b: Column) -> Column:
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        on = (turn == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        # The ray to larger x meets a segment that rises if the place is on its left, one that falls if on its right.
        meets = ((a["y"] > y) != (b["y"] > y)) & F.when(b["y"] > a["y"], turn > 0).otherwise(turn < 0)
        return F.when(on, -1).when(meets, 1).otherwise(0)

    found = _pairs(points, passed)
    return ~F.exists(found, lambda v: v < 0) & (F.aggregate(found, F.lit(0), lambda s, v: s + v) % 2 == 1)


def shells_and_holes(records: DataFrame, rings: str = "rings") -> DataFrame:
    """One row per ring of each record: the record's other columns, ring (its place in the record, from
    0), role ("shell" or "hole"), shell (the place of its shell; a shell's own) and points.

    Rings under four points are left out. A ring that runs clockwise is a shell, any other a hole;
    if a record has no clockwise ring, all its rings are shells. A hole belongs to the first shell
    that holds its first vertex and to none (null) if there is no such shell. Records without rings,
    null shapes among them, have no row.
    """
    # Areas and bounds are worked out once for a ring.
    side = lambda p, n, f: f(F.transform(p, lambda v: v[n]))
    listed = F.transform(F.col(rings), lambda p, i: F.struct(i.cast("int").alias("ring"), p.alias("points")))
    long = F.filter(listed, lambda r: F.size(r["points"]) >= SHORTEST)
    measured = F.transform(long, lambda r: F.struct(
        r["ring"].alias("ring"), (signed_area(r["points"]) < 0).alias("right"), r["points"].alias("points"),
        *(side(r["points"], n, f).alias(f"{m}_{n}") for n in "xy" for m, f in (("low", F.array_min), ("high", F.array_max))),
    ))
    rest = [c for c in records.columns if c != rings]
    one = records.select(*rest, measured.alias("_rings"))
    one = one.withColumns({"_any": F.exists("_rings", lambda r: r["right"]), "_shells": F.filter("_rings", lambda r: r["right"])})

    def home(r: Column) -> Column:
        x, y = r["points"][0]["x"], r["points"][0]["y"]
        near = lambda s: (s["low_x"] < x) & (x < s["high_x"]) & (s["low_y"] < y) & (y < s["high_y"])
        return F.get(F.filter(F.filter("_shells", near), lambda s: holds(s["points"], x, y)), F.lit(0))["ring"]

    given = F.transform("_rings", lambda r: F.struct(
        r["ring"].alias("ring"), F.when(r["right"] | ~F.col("_any"), "shell").otherwise("hole").alias("role"),
        F.when(r["right"] | ~F.col("_any"), r["ring"]).otherwise(home(r)).alias("shell"), r["points"].alias("points"),
    ))
    return one.select(*rest, F.explode(given).alias("_r")).select(*rest, "_r.*")


@F.pandas_udf(T.StringType())
def _raw_hash(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else hashlib.sha256(np.column_stack([a, b]).astype("<f8").tobytes()).hexdigest() for a, b in zip(x, y, strict=True)])


def raw_hash(points: Column) -> Column:
    """SHA-256 of a ring as it stands: x and y of each point as little-endian doubles."""
    return _raw_hash(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


def exterior_hashes(parts: DataFrame, key: str) -> DataFrame:
    """key and exteriors, the sorted hashes of its shells (rows of shells_and_holes)."""
    return parts.where("role = 'shell'").groupBy(key).agg(F.sort_array(F.collect_list(raw_hash(F.col("points")))).alias("exteriors"))
