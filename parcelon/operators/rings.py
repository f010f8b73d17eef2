"""Dissolve of clean coverages into ordered rings; least rectangles, signatures and local measures."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wkb import encode
from ..session import scratch
from .geometry import cross, length, local_plane, segments

_SIDES = T.StructType([T.StructField("length", T.DoubleType()), T.StructField("width", T.DoubleType())])


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in a folder that all machines share (see session.scratch)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark))
    return df.checkpoint()


def outline(edges: DataFrame) -> DataFrame:
    """Edges (key, x0, y0, x1, y1) with the interior on the left that no neighbour of the key cancels.

    An edge that is there twice in the same direction belongs to polygons that overlap: it fails.
    """
    ahead = F.struct("x0", "y0") < F.struct("x1", "y1")
    ends = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    turned = edges.select("key", ends("x0", "x1").alias("xa"), ends("y0", "y1").alias("ya"), ends("x1", "x0").alias("xb"), ends("y1", "y0").alias("yb"), F.when(ahead, 1).otherwise(-1).alias("way"))
    left = turned.groupBy("key", "xa", "ya", "xb", "yb").agg(F.sum("way").alias("way")).where("way <> 0")
    way = F.when(F.abs("way") > 1, F.raise_error(F.lit("polygons of a key overlap")).cast("long")).otherwise(F.col("way"))
    left = left.withColumn("way", way)
    pick = lambda a, b: F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b))
    return left.select("key", pick("xa", "xb").alias("x0"), pick("ya", "yb").alias("y0"), pick("xb", "xa").alias("x1"), pick("yb", "ya").alias("y1"))


def stitch(edges: DataFrame) -> DataFrame:
    """Rings of an outline: key, ring, seq (from 1), x, y.

    Where several edges leave a vertex, the next one is that which bounds the same corner of the
    interior, so that parts which touch in a point stay apart. Rings are labelled and numbered by
    doubling pointers: as many joins as the logarithm of the longest ring, and no ring or key has
    to fit in a task.
    """
    e = kept(edges.withColumn("id", F.monotonically_increasing_id()))
    back = F.atan2(F.col("a.y0") - F.col("a.y1"), F.col("a.x0") - F.col("a.x1"))
    out = F.atan2(F.col("b.y1") - F.col("b.y0"), F.col("b.x1") - F.col("b.x0"))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.x1") == F.col("b.x0")) & (F.col("a.y1") == F.col("b.y0"))
    corner = F.pmod(back - out, F.lit(2 * math.pi))
    follows = kept(e.alias("a").join(e.alias("b"), on).groupBy(F.col("a.id").alias("id")).agg(F.min_by("b.id", corner).alias("next")))

    state = follows.withColumn("ring", F.least("id", "next"))
    while True:
        far = state.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("ring").alias("other"))
        step = state.join(far, "next").select("id", F.col("then").alias("next"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved"))
        step = kept(step)
        state = step.drop("moved")
        if not step.where("moved").head(1):
            break

    # Steps to the ring's last edge: that before its least one.
    rings = state.select("id", "ring")
    tail = follows.join(rings, "id").withColumn("next", F.when(F.col("next") != F.col("ring"), F.col("next")))
    rank = kept(tail.withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
    while rank.where("next IS NOT NULL").head(1):
        far = rank.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        rank = kept(rank.join(far, "next", "left").select("id", F.col("then").alias("next"), "ring", (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    size = rank.groupBy("ring").agg(F.max("left").alias("most"))
    found = rank.join(size, "ring").select("id", "ring", (F.col("most") - F.col("left") + 1).alias("seq"))
    return e.join(found, "id").select("key", "ring", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))


def dissolve(edges: DataFrame) -> DataFrame:
    """Union by key of polygons that share whole edges: exteriors run left about, holes right about."""
    return stitch(outline(edges))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, left about; points that lie on its edges are left out."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows) -> list:
        line: list = []
        for p in rows:
            while len(line) > 1 and (line[-1][0] - line[-2][0]) * (p[1] - line[-2][1]) <= (line[-1][1] - line[-2][1]) * (p[0] - line[-2][0]):
                line.pop()
            line.append(p)
        return line[:-1]

    return np.array(half(points) + half(points[::-1]))


def rectangle(points: np.ndarray) -> tuple[float, float]:
    """Length and width of the least rectangle: one side lies on an edge of the hull."""
    edge = hull(points)
    if len(edge) < 2:
        return 0.0, 0.0
    d = np.roll(edge, -1, axis=0) - edge
    u = d / np.hypot(d[:, 0], d[:, 1])[:, None]
    along, across = edge @ u.T, edge @ np.stack([-u[:, 1], u[:, 0]])
    sides = np.stack([np.ptp(along, axis=0), np.ptp(across, axis=0)])
    best = sides[:, np.argmin(sides[0] * sides[1])]
    return float(best.max()), float(best.min())


@F.pandas_udf(_SIDES)
def least_rectangle(points: pd.Series) -> pd.DataFrame:
    """Of an array of (x, y); null for null, zeros for fewer than two different points."""
    made = [(None, None) if p is None else rectangle(np.array([(q["x"], q["y"]) for q in p], float).reshape(-1, 2)) for p in points]
    return pd.DataFrame(made, columns=["length", "width"], dtype=float)


def normal_ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed, clockwise, from its least vertex; the same for each start and direction."""
    ring = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
    # The sum starts at the first vertex, so that the sign of a small ring's area is sure.
    (ax, ay), n = ring[0], len(ring)
    twice = sum((ring[i][0] - ax) * (ring[(i + 1) % n][1] - ay) - (ring[(i + 1) % n][0] - ax) * (ring[i][1] - ay) for i in range(n))
    ring = ring[::-1] if twice > 0 else ring
    at = ring.index(min(ring))
    return [*ring[at:], *ring[:at], ring[at]]


@F.pandas_udf(T.StringType())
def wkb_signature(points: pd.Series) -> pd.Series:
    """SHA-256 of the well-known binary of a polygon of one normal ring; null for none or an empty one."""
    made = [None if p is None or not len(p) else hashlib.sha256(encode([[normal_ring([(q["x"], q["y"]) for q in p])]])).hexdigest() for p in points]
    return pd.Series(made, dtype=object)


def local_measures(vertices: DataFrame) -> DataFrame:
    """ring, area, perimeter, length, width, aspect: in metres on the ring's own plane; the sides are
    those of the least rectangle, and a ring without width has no aspect."""
    plane = local_plane(vertices)
    sizes = segments(plane).groupBy("ring").agg((F.abs(F.sum(cross())) / 2).alias("area"), F.sum(length()).alias("perimeter"))
    boxes = ring_arrays(plane).select("ring", least_rectangle("points").alias("r"))
    aspect = F.col("r.length") / F.nullif(F.col("r.width"), F.lit(0.0))
    return sizes.join(boxes, "ring").select("ring", "area", "perimeter", "r.length", "r.width", aspect.alias("aspect"))


def ring_arrays(vertices: DataFrame) -> DataFrame:
    """ring, points: the vertices of each ring in order."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    return vertices.groupBy("ring").agg(F.transform(rows, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("points"))


def ring_areas(vertices: DataFrame) -> DataFrame:
    """key, ring, n, area: signed by the direction."""
    order = Window.partitionBy("key", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    part = vertices.select("key", "ring", (F.col("x") * after("y") - after("x") * F.col("y")).alias("cross"))
    return part.groupBy("key", "ring").agg(F.count("*").alias("n"), (F.sum("cross") / 2).alias("area"))
