"""Overlay of general polygons by bands: areas of what either side, or both, cover.

Polygons enter as closed segments (key, side, x0, y0, x1, y1), of two sides, a and b. A key's
segments are cut into bands of y, and a task takes one band of one key: what lies inside a polygon
is decided along each horizontal line on its own, so bands need nothing from each other. Within a
band the ends and the crossings of the segments part it into slabs in which no two segments cross;
a slab is a row of trapezoids, each inside or outside of either side. The number of bands follows
the number of segments, so a large polygon is spread over many tasks.

A place is inside a side if the winding number of its rings there is not 0: polygons of one side
that overlap count once, and holes run against their shells. With rule "parity", it is inside if a
ray crosses an odd number of segments, whatever the direction of the rings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import SPHERE_RADIUS, box_join

#: Segments for a band, as if they were spread evenly.
BAND_SEGMENTS = 128


def equal_area(segments: DataFrame) -> DataFrame:
    """Degrees to metres on the equal-area cylinder, so that overlay areas are square metres."""
    x = lambda c: F.radians(c) * SPHERE_RADIUS
    y = lambda c: F.sin(F.radians(c)) * SPHERE_RADIUS
    return segments.withColumns({"x0": x("x0"), "x1": x("x1"), "y0": y("y0"), "y1": y("y1")})


def slab_areas(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, side: np.ndarray, low: float, high: float, rule: str) -> tuple[float, float, float]:
    """Areas of a only, b only, both, between two values of y."""
    up = np.where(y1 > y0, 1, -1)
    turned = y1 < y0
    x0, x1, y0, y1 = np.where(turned, x1, x0), np.where(turned, x0, x1), np.where(turned, y1, y0), np.where(turned, y0, y1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (x1 - x0) / (y1 - y0)
        # Crossings of the lines, kept where both segments are.
        at = (x0[:, None] - slope[:, None] * y0[:, None] - x0[None, :] + slope[None, :] * y0[None, :]) / (slope[None, :] - slope[:, None])
        inside = (at > np.maximum(y0[:, None], y0[None, :])) & (at < np.minimum(y1[:, None], y1[None, :]))
    cuts = np.unique(np.concatenate([np.clip(np.concatenate([y0, y1, at[inside]]), low, high), [low, high]]))
    found = np.zeros(4)
    for bottom, top in zip(cuts[:-1], cuts[1:], strict=True):
        middle = (bottom + top) / 2
        live = np.flatnonzero((y0 < middle) & (y1 > middle))
        x = x0[live] + slope[live] * (middle - y0[live])
        order = np.argsort(x, kind="stable")
        x, live = x[order], live[order]
        turn = np.where(side[live][:, None] == np.array([0, 1])[None, :], up[live][:, None], 0).cumsum(axis=0)
        held = turn % 2 != 0 if rule == "parity" else turn != 0
        kind = held[:-1, 0] + 2 * held[:-1, 1]
        found += np.bincount(kind, np.diff(x) * (top - bottom), 4)
    return float(found[1]), float(found[2]), float(found[3])


def overlay(segments: DataFrame, rule: str = "winding", band_segments: int = BAND_SEGMENTS) -> DataFrame:
    """segments: key, side ("a" or "b"), x0, y0, x1, y1 of closed rings. Per key: a_only, b_only, both
    (areas in the unit of the coordinates, squared)."""
    s = segments.select("key", (F.col("side") == "b").cast("int").alias("side"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    bounds = s.groupBy("key").agg(F.min(F.least("y0", "y1")).alias("low"), F.max(F.greatest("y0", "y1")).alias("high"), F.greatest(F.lit(1), F.ceil(F.count("*") / band_segments)).alias("bands"))
    keys = bounds.where("high > low").withColumn("height", (F.col("high") - F.col("low")) / F.col("bands"))
    place = lambda y: F.least(F.col("bands") - 1, F.floor((y - F.col("low")) / F.col("height")))
    dealt = s.where("y0 <> y1").join(keys.drop("high"), "key")
    dealt = dealt.withColumn("band", F.explode(F.sequence(place(F.least("y0", "y1")), place(F.greatest("y0", "y1")))))

    def areas(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        low = row["low"] + row["band"] * row["height"]
        found = slab_areas(*(group[c].to_numpy() for c in ("x0", "y0", "x1", "y1", "side")), low, low + row["height"], rule)
        return pd.DataFrame([(row["key"], *found)], columns=["key", "a_only", "b_only", "both"])

    kind = segments.schema["key"].dataType.simpleString()
    each = dealt.groupBy("key", "band").applyInPandas(areas, f"key {kind}, a_only double, b_only double, both double")
    zero = bounds.select("key", *(F.lit(0.0).alias(c) for c in ("a_only", "b_only", "both")))  # flat keys too
    return each.union(zero).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("a_only", "b_only", "both")))


def version_areas(segments: DataFrame, rule: str = "winding", tolerance: float = 0.0) -> DataFrame:
    """Differences of two versions of a polygon both ways: key, lost (in a, not in b), added, lost_empty,
    added_empty, with what is no larger than the tolerance counted as empty."""
    found = overlay(segments, rule)
    return found.select("key", F.col("a_only").alias("lost"), F.col("b_only").alias("added"), (F.col("a_only") <= tolerance).alias("lost_empty"), (F.col("b_only") <= tolerance).alias("added_empty"))


def bounds_of(segments: DataFrame) -> DataFrame:
    """id and box of each polygon (id, x0, y0, x1, y1)."""
    return segments.groupBy("id").agg(*(f(getattr(F, h)(f"{c}0", f"{c}1")).alias(f"{c}{n}") for c in "xy" for n, f, h in (("min", F.min, "least"), ("max", F.max, "greatest"))))


def pair_segments(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Segments of both polygons of each pair (key, id, b_id)."""
    a = pairs.select("key", "id").join(left, "id").select("key", F.lit("a").alias("side"), "x0", "y0", "x1", "y1")
    b = pairs.select("key", F.col("b_id").alias("id")).join(right, "id").select("key", F.lit("b").alias("side"), "x0", "y0", "x1", "y1")
    return a.union(b)


def self_overlaps(polygons: DataFrame, cell: float, rule: str = "winding", least: float = 0.0) -> DataFrame:
    """a, b, area of each pair of polygons (id, x0, y0, x1, y1) that cover a place both; polygons that
    only touch do not. `cell` is the grid on which boxes meet."""
    box = bounds_of(polygons)
    met = box_join(box, box.toDF(*(f"b_{c}" for c in box.columns)), cell, same=True).select("id", "b_id")
    pairs = met.withColumn("key", F.to_json(F.struct("id", "b_id")))
    found = overlay(pair_segments(pairs, polygons, polygons), rule)
    return pairs.join(found, "key").where(F.col("both") > least).select(F.col("id").alias("a"), F.col("b_id").alias("b"), F.col("both").alias("area"))


def coverage(polygons: DataFrame, layer: DataFrame, cell: float, rule: str = "winding") -> DataFrame:
    """id, area, covered, layer_ids of each polygon: how much of it the polygons of a layer cover
    together, and which of them cover some of it. Both have id, x0, y0, x1, y1."""
    box = bounds_of(layer)
    met = box_join(bounds_of(polygons), box.toDF(*(f"b_{c}" for c in box.columns)), cell).select("id", "b_id")
    mine = polygons.select(F.col("id").alias("key"), F.lit("a").alias("side"), "x0", "y0", "x1", "y1")
    theirs = met.join(layer.withColumnRenamed("id", "b_id"), "b_id").select(F.col("id").alias("key"), F.lit("b").alias("side"), "x0", "y0", "x1", "y1")
    whole = overlay(mine.union(theirs), rule).select(F.col("key").alias("id"), (F.col("a_only") + F.col("both")).alias("area"), F.col("both").alias("covered"))
    pairs = met.withColumn("key", F.to_json(F.struct("id", "b_id")))
    single = overlay(pair_segments(pairs, polygons, layer), rule).where("both > 0").join(pairs, "key")
    ids = single.groupBy("id").agg(F.array_sort(F.collect_set("b_id")).alias("layer_ids"))
    return whole.join(ids, "id", "left").select("id", "area", "covered", F.coalesce("layer_ids", F.array().cast(ids.schema["layer_ids"].dataType)).alias("layer_ids"))


def classify_voids(holes: DataFrame, published: DataFrame, source: DataFrame, municipal: DataFrame, cell: float) -> DataFrame:
    """id, area, void (what the published layer leaves open), cause, context, decision of each hole.

    Holes have id and segments; the layers besides zone. A void that both inputs cover came up in
    processing, one that neither covers is in the source. A hole that inputs of several zones touch
    lies between zones; there, and where a published zone covers part of it, the rule is to keep it.
    """
    def inside(layer: DataFrame, name: str) -> DataFrame:
        return coverage(holes, layer.select("id", "x0", "y0", "x1", "y1"), cell).select("id", "area", F.col("covered").alias(name), F.col("layer_ids").alias(f"{name}_ids"))

    p, s, m = inside(published, "published"), inside(source, "source").drop("area"), inside(municipal, "municipal").drop("area")
    found = p.join(s, "id").join(m, "id")
    # The void is what no published polygon covers; inputs matter there only.
    beyond = lambda layer, name: coverage(holes, layer.select(F.concat(F.lit(name), F.col("id").cast("string")).alias("id"), "x0", "y0", "x1", "y1").union(published.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), "x0", "y0", "x1", "y1")), cell).select("id", F.col("covered").alias(f"{name}_or_published"))
    found = found.join(beyond(source, "s"), "id").join(beyond(municipal, "m"), "id")
    small = F.col("area") * 1e-9 + 1e-15  # rounding of the slabs
    found = found.withColumn("void", F.col("area") - F.col("published"))
    in_source, in_municipal = F.col("s_or_published") - F.col("published") > small, F.col("m_or_published") - F.col("published") > small
    cause = F.when(F.col("void") <= small, "undetermined").when(~in_source & ~in_municipal, "source").when(in_source & in_municipal, "processing").otherwise("undetermined")
    touching = touching_zones(holes, source.select("id", "zone", "x0", "y0", "x1", "y1"), cell).union(touching_zones(holes, municipal.select("id", "zone", "x0", "y0", "x1", "y1"), cell))
    zones = touching.groupBy("id").agg(F.array_sort(F.collect_set("zone")).alias("adjacent_zones"))
    found = found.join(zones, "id", "left").withColumn("adjacent_zones", F.coalesce("adjacent_zones", F.array().cast("array<int>")))
    between = F.size("adjacent_zones") > 1
    keep = between | (F.size("published_ids") > 0)
    return found.select("id", "area", "void", cause.alias("cause"), F.when(between, "between zones").otherwise("inside one zone").alias("context"), F.when(keep, "keep").otherwise("confirm").alias("decision"), "adjacent_zones")


def touching_zones(holes: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """id, zone of the layer's polygons whose boxes meet the hole's."""
    box = bounds_of(layer).join(layer.select("id", F.col("zone").cast("int").alias("zone")).distinct(), "id")
    named = box.select(F.col("id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")), "zone")
    return box_join(bounds_of(holes), named, cell).select("id", "zone")

