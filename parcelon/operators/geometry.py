"""Rings as rows: vertices to segments, measures as sums over segments, parity predicates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

SPHERE_RADIUS = 6371008.8
#: GRS80.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
ECCENTRICITY2 = FLATTENING * (2 - FLATTENING)
WGS84_FLATTENING = 1 / 298.257223563

#: Twice the area by length, in degrees, that makes a ring flat: some units in the last place.
FLAT = 1e-12


def segments(vertices: DataFrame) -> DataFrame:
    """ring, seq, x, y to closed segments ring, seq, x0, y0, x1, y1."""
    order = Window.partitionBy("ring").orderBy("seq")
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(first))
    return vertices.select("ring", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1"))


def sphere_area() -> Column:
    """Equal-area ring area on the sphere; decides thresholds."""
    part = F.radians(F.col("x1") - F.col("x0")) * (F.sin(F.radians("y0")) + F.sin(F.radians("y1")))
    return F.abs(F.sum(part)) * (SPHERE_RADIUS**2 / 2)


def authalic_area(flattening: float) -> Column:
    """Ring area by authalic latitudes on an ellipsoid with the axis of GRS80."""
    e2 = flattening * (2 - flattening)
    e = math.sqrt(e2)

    def q(lat: str) -> Column:
        s = F.sin(F.radians(lat))
        return (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(e * s) / e)

    return F.abs(F.sum(F.radians(F.col("x1") - F.col("x0")) * (q("y0") + q("y1")))) * (AXIS**2 / 4)


def grs80_area() -> Column:
    """Ring area by authalic latitudes on the ellipsoid; for reports."""
    return authalic_area(FLATTENING)


def wgs84_area() -> Column:
    """Ring area as the equal-area cylinder of EPSG:6933 gives it, whatever its standard parallel."""
    return authalic_area(WGS84_FLATTENING)


def local_plane(vertices: DataFrame) -> DataFrame:
    """ring, seq, x, y in metres on the plane that touches the ellipsoid in the middle of the ring's
    bounds. The scale eastward is that of the middle, so a measure may be off by half the ring's height
    over the radius, times the tangent of the latitude: about a millionth for rings of some ten metres
    at middle latitudes, more in proportion to their size."""
    ring = Window.partitionBy("ring")
    middle = lambda n: (F.min(n).over(ring) + F.max(n).over(ring)) / 2
    v = vertices.select("ring", "seq", "x", "y", middle("x").alias("lon"), middle("y").alias("lat"))
    w = 1 - ECCENTRICITY2 * F.sin(F.radians("lat")) * F.sin(F.radians("lat"))
    east = AXIS / F.sqrt(w) * F.cos(F.radians("lat"))
    north = AXIS * (1 - ECCENTRICITY2) / (w * F.sqrt(w))
    return v.select("ring", "seq", (F.radians(F.col("x") - F.col("lon")) * east).alias("x"), (F.radians(F.col("y") - F.col("lat")) * north).alias("y"))


def cross() -> Column:
    return F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")


def centroids(segments: DataFrame) -> DataFrame:
    """ring, cx, cy of every ring. The sums start at the first vertex, so that small areas stay
    precise; a ring whose area is no more than what rounding of its coordinates can make is flat
    and has a null centroid."""
    whole = Window.partitionBy("ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = segments.withColumn("fx", F.first("x0").over(whole)).withColumn("fy", F.first("y0").over(whole))
    s = s.select("ring", "fx", "fy", *((F.col(f"{n}{i}") - F.col(f"f{n}")).alias(f"{n}{i}") for n in "xy" for i in "01"))
    a = s.groupBy("ring").agg(F.first("fx").alias("fx"), F.first("fy").alias("fy"), F.sum(cross()).alias("c"), F.sum(length()).alias("l"), *(F.sum((F.col(f"{n}0") + F.col(f"{n}1")) * cross()).alias(f"s{n}") for n in "xy"))
    middle = lambda n: F.when(F.abs("c") > FLAT * F.col("l"), F.col(f"f{n}") + F.col(f"s{n}") / F.nullif(3 * F.col("c"), F.lit(0.0)))
    return a.select("ring", middle("x").alias("cx"), middle("y").alias("cy"))


def planar_area() -> Column:
    """Shoelace area in square degrees, scaled at the mean latitude."""
    return F.abs(F.sum(cross())) / 2 * (111320.0**2) * F.cos(F.radians(F.avg("y0")))


def length() -> Column:
    return F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def crosses_ray(px: str, py: str, of: Callable[[str], Column] = F.col) -> Column:
    """A ray from the point to larger x crosses the segment, whose ends `of` gives by their names."""
    x, y = F.col(px), F.col(py)
    return ((of("y0") > y) != (of("y1") > y)) & (x < of("x0") + (y - of("y0")) * (of("x1") - of("x0")) / F.nullif(of("y1") - of("y0"), F.lit(0.0)))


def point_segment_distance(px: Column, py: Column) -> Column:
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    span = dx * dx + dy * dy
    t = F.when(span == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - F.col("x0")) * dx + (py - F.col("y0")) * dy) / F.nullif(span, F.lit(0.0)))))
    return F.hypot(px - F.col("x0") - t * dx, py - F.col("y0") - t * dy)


def densified(segments: DataFrame, spacing: float) -> DataFrame:
    """ring, px, py, step: places along every segment no further apart than the spacing; a ring's
    last segment also gives its end, so that the closing place counts twice."""
    last = F.max("seq").over(Window.partitionBy("ring"))
    n = F.greatest(F.lit(1), F.ceil(F.round(length(), 6) / spacing)).cast("long")
    f = segments.withColumn("last", last).withColumn("n", n).withColumn("len", length())
    f = f.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.when(F.col("seq") < F.col("last"), 1).otherwise(0))))
    at = lambda c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("i") / F.col("n")
    return f.select("ring", "seq", "i", at("x").alias("px"), at("y").alias("py"), (F.col("len") / F.col("n")).alias("step"))


def boundary_distance(segments: DataFrame, targets: DataFrame, spacing: float) -> DataFrame:
    """ring, samples, most, bound: the largest distance of a ring's densified boundary from the
    target segments of the same number, and a bound for the places between the samples."""
    j = densified(segments, spacing).join(targets.drop("seq"), "ring")
    d = j.groupBy("ring", "seq", "i").agg(F.first("step").alias("step"), F.min(point_segment_distance(F.col("px"), F.col("py"))).alias("d"))
    return d.groupBy("ring").agg(F.count("*").alias("samples"), F.max("d").alias("most"), (F.max("d") + F.max("step") / 2).alias("bound"))


def self_crossings(segments: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """ring, i, j: segments of a ring that are no neighbours and cross properly: each parts the ends
    of the other by more than a tolerance."""
    a = segments.withColumn("n", F.count("*").over(Window.partitionBy("ring"))).withColumnRenamed("seq", "i")
    b = segments.select("ring", F.col("seq").alias("j"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))

    def parted(s: str, o: str) -> Column:
        c = F.col
        side = lambda k: (c(f"{s}x1") - c(f"{s}x0")) * (c(f"{o}y{k}") - c(f"{s}y0")) - (c(f"{s}y1") - c(f"{s}y0")) * (c(f"{o}x{k}") - c(f"{s}x0"))
        return ((side(0) > tolerance) & (side(1) < -tolerance)) | ((side(0) < -tolerance) & (side(1) > tolerance))

    return a.join(b, "ring").where("j >= i + 2 AND NOT (i = 1 AND j = n)").where(parted("", "b_") & parted("b_", "")).select("ring", "i", "j")


def cells(low: Column, high: Column, size: float) -> Column:
    """Numbers of the grid cells that a range touches."""
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def shuffled(rows: DataFrame) -> DataFrame:
    """For a side of a join that explode() made: Spark estimates it by the bytes of its files, however
    many rows come of one, so it would send a large side to the driver and broadcast it."""
    return rows.hint("merge")


#: Levels of the grid of box_join: cells of the size times 4 to the power of each.
LEVELS = range(-12, 13)


def levels_of(one: DataFrame, other: DataFrame) -> list[int]:
    """The levels that occur, at most as many as LEVELS has; level 0 if there is none."""
    return sorted(one.union(other).agg(F.collect_set("level")).first()[0]) or [0]


def box_level(size: float, p: str = "") -> Column:
    """The level whose cells are about as wide as a box; null if it has no extent."""
    wide = F.greatest(F.col(f"{p}xmax") - F.col(f"{p}xmin"), F.col(f"{p}ymax") - F.col(f"{p}ymin"))
    step = F.ceil(F.log2(F.when(wide > 0, wide) / size) / 2)
    return F.when(wide > 0, F.least(F.lit(LEVELS[-1]), F.greatest(F.lit(LEVELS[0]), step)).cast("int"))


def box_join(left: DataFrame, right: DataFrame, size: float, same: bool = False) -> DataFrame:
    """Pairs of boxes (id, xmin, ymin, xmax, ymax; right with prefix b_) that overlap or touch.

    A range join becomes an equi-join on cells of nested grids. A box belongs to the level whose cells
    are about as wide as it is, so it touches few cells however wide it is, and is looked up in those
    of the wider levels that occur (a first job finds them). A pair meets at the level of its wider
    box, where all that shares a cell is near, so that a dense cell costs about in proportion to what
    it yields. This does not hold for long, thin boxes, whose cells are much wider than they are.
    Boxes without extent belong to the narrowest level. A pair that meets in several cells is reported
    in that of the lower left corner of the overlap only. A box with a null bound meets none.
    """
    level = lambda p: box_level(size, p)
    levels = levels_of(left.select(level("").alias("level")), right.select(level("b_").alias("level")))

    def placed(rows: DataFrame, p: str) -> DataFrame:
        # The wider box of a pair, or both, are the own ones (way 1: that of the left).
        own = F.coalesce(level(p), F.lit(levels[0]))
        ways = []
        for n in levels:
            for way, meets in ((1, own == n if not p else own <= n), (2, own < n if not p else own == n)):
                ways.append(F.when(meets, F.struct(F.lit(way).alias("way"), F.lit(n).alias("level"), F.lit(size * 4.0**n).alias("wide"))))
        found = rows.withColumn("at", F.explode(F.array_compact(F.array(*ways))))
        for n in "xy":
            span = F.sequence(*(F.floor(F.col(f"{p}{n}{m}") / F.col("at.wide")).cast("long") for m in ("min", "max")))
            found = found.withColumn(f"c{n}", F.explode(span))
        return found.select(*rows.columns, F.col("at.way").alias("way"), F.col("at.level").alias("level"), "cx", "cy", *([] if p else [F.col("at.wide").alias("wide")]))

    meet = (F.col("xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("ymax"))
    home = (F.floor(F.greatest("xmin", "b_xmin") / F.col("wide")) == F.col("cx")) & (F.floor(F.greatest("ymin", "b_ymin") / F.col("wide")) == F.col("cy"))
    joined = shuffled(placed(left, "")).join(shuffled(placed(right, "b_")), ["way", "level", "cx", "cy"]).where(meet & home)
    return (joined.where("id < b_id") if same else joined).drop("way", "level", "wide", "cx", "cy")


def outer_boxes(boxes: DataFrame) -> DataFrame:
    """xmin, ymin, xmax, ymax: boxes that cover together what all do. Of those with the same lower left
    corner, one that lies in the widest goes."""
    corner = Window.partitionBy("xmin", "ymin")
    far = F.max(F.struct("xmax", "ymax")).over(corner)
    b = boxes.select("xmin", "ymin", "xmax", "ymax").distinct().withColumn("far", far)
    return b.where((F.col("xmax") == F.col("far.xmax")) & (F.col("ymax") == F.col("far.ymax")) | (F.col("ymax") > F.col("far.ymax"))).drop("far")


def uncovered(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """The points (px, py; further columns stay) that lie in no box, nor on the edge of one.

    Boxes lie in the cells of their level, as in box_join; a point is in one cell of each. The levels
    follow one another from the widest, so each meets only what is left, and a point is tested until
    the first box that holds it.
    """
    b = outer_boxes(boxes.select("xmin", "ymin", "xmax", "ymax").dropna()).withColumn("level", box_level(size))
    levels = levels_of(b.select("level"), b.select("level").limit(0))
    b = b.withColumn("level", F.coalesce("level", F.lit(levels[0])))
    left = points
    for n in reversed(levels):
        wide = size * 4.0**n
        own = b.where(F.col("level") == n).drop("level")
        for x in "xy":
            own = own.withColumn(f"c{x}", F.explode(cells(F.col(f"{x}min"), F.col(f"{x}max"), wide)))
        holds = F.col("px").between(F.col("xmin"), F.col("xmax")) & F.col("py").between(F.col("ymin"), F.col("ymax"))
        at = left.withColumns({f"p_c{x}": F.floor(F.col(f"p{x}") / wide) for x in "xy"})
        left = shuffled(at).join(shuffled(own), (F.col("p_cx") == F.col("cx")) & (F.col("p_cy") == F.col("cy")) & holds, "left_anti").drop("p_cx", "p_cy")
    return left


SIDE = "x0", "y0", "x1", "y1"

def crossing_pairs(segments: DataFrame, tolerance: float, across: float, thin: float, apart: str) -> DataFrame:
    """a, b (a < b): segments (id, x0, y0, x1, y1) that differ in the column `apart` and cross properly:
    each parts the ends of the other by more than a tolerance.

    Bounds are taken along the diagonals of the plane (u = x + y, v = x - y), where rising segments are
    long in u and falling ones in v. A rising and a falling segment meet in square cells of the width
    `across`; two of the same direction in cells that are `across` * 8 long and `thin` wide, as they
    cross only where they are close. Other widths give the same pairs. A pair that meets in several
    cells is reported in that of the lower left corner of the overlap only.
    """
    c, slack = F.col, 1e-9  # bounds are sums of rounded coordinates
    ends = {f"{n}{m}": f(c("x0") + k * c("y0"), c("x1") + k * c("y1")) + by for n, k in (("u", 1), ("v", -1)) for m, f, by in (("min", F.least, -slack), ("max", F.greatest, slack))}
    s = segments.select("id", apart, "x0", "y0", "x1", "y1").withColumns(ends)
    up = (c("x1") - c("x0")) * (c("y1") - c("y0")) >= 0
    long = across * 8
    kind = lambda k, u, v: F.struct(F.lit(k).alias("kind"), F.lit(float(u)).alias("wu"), F.lit(float(v)).alias("wv"))
    mixed, rising, falling = kind(0, across, across), kind(1, long, thin), kind(2, thin, long)

    def placed(kinds: Column) -> DataFrame:
        found = s.withColumn("at", F.explode(kinds)).select(*s.columns, "at.*")
        for n in "uv":
            found = found.withColumn(f"c{n}", F.explode(F.sequence(*(F.floor(c(f"{n}{m}") / c(f"w{n}")).cast("long") for m in ("min", "max")))))
        return found

    left = placed(F.when(up, F.array(mixed, rising)).otherwise(F.array(falling)))
    right = placed(F.when(up, F.array(rising)).otherwise(F.array(mixed, falling))).drop("wu", "wv")
    right = right.select("kind", "cu", "cv", *(c(n).alias(f"b_{n}") for n in s.columns))

    def parted(p: str, o: str) -> Column:
        side = lambda n: (c(f"{p}x1") - c(f"{p}x0")) * (c(f"{o}y{n}") - c(f"{p}y0")) - (c(f"{p}y1") - c(f"{p}y0")) * (c(f"{o}x{n}") - c(f"{p}x0"))
        return ((side(0) > tolerance) & (side(1) < -tolerance)) | ((side(0) < -tolerance) & (side(1) > tolerance))

    meet = (c("umin") <= c("b_umax")) & (c("b_umin") <= c("umax")) & (c("vmin") <= c("b_vmax")) & (c("b_vmin") <= c("vmax"))
    home = (F.floor(F.greatest("umin", "b_umin") / c("wu")) == c("cu")) & (F.floor(F.greatest("vmin", "b_vmin") / c("wv")) == c("cv"))
    once = (c("kind") == 0) | (c("id") < c("b_id"))
    met = shuffled(left).join(shuffled(right), ["kind", "cu", "cv"]).where(meet & once & home & (c(apart) != c(f"b_{apart}")) & parted("", "b_") & parted("b_", ""))
    return met.select(F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b"))


#: Parts that the rings of a cell are dealt to; each part meets all places of the cell.
PARTS = 16
#: Sides of a ring that are tested without a lambda.
UNROLLED = 8


def here(value: Column) -> Column:
    """The value, computed in this place of the plan: Spark takes it for one that depends on the
    partition, so it moves no filter on what stands beside it onto the rows before they are grouped."""
    return F.when(F.spark_partition_id() >= 0, value)


def ring_classes(rows: DataFrame, *names: str) -> DataFrame:
    """class, rings, n, parts: rings whose rows are equal in the named columns of doubles, whatever
    their order, by the least ring of them; parts is the array of these rows. A row for each class."""
    parts = F.sort_array(F.collect_list(F.struct(*names)))
    # Plain numbers, as structs take half as much again in the exchange.
    flat = F.flatten(F.transform(parts, lambda s: F.array(*(s[n] for n in names))))
    r = rows.groupBy("ring").agg(flat.alias("flat"))
    r = r.groupBy("flat").agg(F.min("ring").alias("class"), F.collect_list("ring").alias("rings"), F.count("*").alias("n"))
    part = lambda i: F.struct(*(F.get("flat", len(names) * i + k).alias(n) for k, n in enumerate(names)))
    return r.select("class", "rings", "n", F.transform(F.sequence(F.lit(0), (F.size("flat") / len(names)).cast("int") - 1), part).alias("parts"))


def places_in_classes(places: DataFrame, classes: DataFrame, width: float, height: float) -> DataFrame:
    """The distinct places (px, py) in the rings of a class (ring_classes of SIDE) by even-odd parity;
    a row for each place and class, with the further columns of both but the parts.

    A ring goes whole to the cells that its bounds touch, and meets the places of each; only sides of
    rings whose bounds hold a place are tested. Cells should be about as wide and high as a ring or
    somewhat less: then few rows are sent, however long the sides are. All that a place meets of a
    ring lies in its one cell and in one row, so sides are counted there and nothing is shuffled
    after the join. The first UNROLLED sides are terms of one expression, which is compiled; a
    lambda tests those beyond them only. With the lambda in the condition the join itself is not
    compiled as a whole, so the terms lie in methods small enough for the JVM to compile. Level
    sides cross no ray.
    """
    standing = lambda s: (s["y0"] != s["y1"]) & s["x0"].isNotNull() & s["x1"].isNotNull()
    flat = F.flatten(F.transform(F.filter("parts", standing), lambda s: F.array(*(s[n] for n in SIDE))))
    every = lambda k: F.transform(F.sequence(F.lit(0), (F.size("flat") / 2).cast("int") - 1), lambda i: F.get("flat", 2 * i + k))
    slack = 1e-9  # degrees: a crossing is computed, so it may lie beyond the ends of its side
    r = classes.withColumn("flat", flat).drop("parts")
    r = r.select("*", here(F.pmod(F.xxhash64("class"), F.lit(PARTS))).alias("part"), *(f(every(k)).alias(f"{x}{m}") for k, x in enumerate("xy") for m, f in (("min", F.array_min), ("max", F.array_max))))
    r = r.withColumn("cy", F.explode(cells(F.col("ymin"), F.col("ymax"), height)))
    r = r.withColumn("cx", F.explode(cells(F.col("xmin") - slack, F.col("xmax") + slack, width)))
    p = places.select("*", F.floor(F.col("px") / width).alias("cx"), F.floor(F.col("py") / height).alias("cy"))
    p = p.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    # A given number of parts is kept: by the bytes of rings and places there would be a few tasks, however much they yield.
    r = r.repartition(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cx", "cy", "part")
    held = F.col("px").between(F.col("xmin") - slack, F.col("xmax") + slack) & (F.col("py") >= F.col("ymin")) & (F.col("py") < F.col("ymax"))
    crosses = lambda k: crosses_ray("px", "py", lambda n: F.get("flat", 4 * k + SIDE.index(n)))
    n = F.size("flat") / 4
    some = lambda low, high: sum((F.when(crosses(F.lit(k)), 1).otherwise(0) for k in range(low, high)), F.lit(0))
    more = F.size(F.filter(F.sequence(F.lit(UNROLLED), n.cast("int") - 1), crosses))
    count = some(0, 4) + F.when(n > 4, some(4, UNROLLED)).otherwise(0) + F.when(n > UNROLLED, more).otherwise(0)
    return shuffled(r).join(shuffled(p), ["cx", "cy", "part"]).where(held & (count % 2 == 1)).select(*places.columns, *(n for n in classes.columns if n != "parts"))


def points_in_rings(points: DataFrame, segments: DataFrame, width: float, height: float) -> DataFrame:
    """pid, ring: points (pid, px, py) in rings (closed segments) by even-odd parity, see
    places_in_classes. Of equal points and of equal rings one is tested; the copies travel along as
    arrays, and pairs are made of them within the row at last, so that none is shuffled."""
    places = points.groupBy("px", "py").agg(F.collect_list("pid").alias("pids"))
    hits = places_in_classes(places, ring_classes(segments, *SIDE), width, height)
    return hits.select("pids", F.explode("rings").alias("ring")).select(F.explode("pids").alias("pid"), "ring")


def ring_counts(points: DataFrame, segments: DataFrame, width: float, height: float) -> DataFrame:
    """pid, n: the number of rings that each point is in, see points_in_rings; no pair is made of copies."""
    hits = places_in_classes(points.select("px", "py").distinct(), ring_classes(segments, *SIDE).drop("rings"), width, height)
    n = hits.groupBy("px", "py").agg(F.sum("n").alias("n"))
    return points.join(n, ["px", "py"], "left").select("pid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def alike_rings(left: DataFrame, right: DataFrame, tolerance: float, most: float, same: bool = False, digits: int | None = None) -> DataFrame:
    """ring, b_ring, d of the rings (ring, seq, x, y) whose bounds differ by no more than the
    tolerance and whose discrete Hausdorff distance is no more than `most`; same: of one table with
    itself (left), with ring < b_ring; digits: d is rounded to so many, once for all copies.

    Of rings with the same vertices one is measured; copies are paired at last, within the row. The
    bounds meet in an equi-join on cells of three tolerances: one side is in one cell, the other in
    all that lie within the tolerance of it, so a pair is found once. With itself, a table's classes
    are stored and meet in one direction.
    """
    names = [f"{n}{m}" for n in "xy" for m in ("min", "max")]
    ends = {f"{n}{m}": f(F.col("parts").getField(n)) for n in "xy" for m, f in (("min", F.array_min), ("max", F.array_max))}
    a = ring_classes(left, "x", "y").drop("n")
    if same:
        path = f"{scratch(a.sparkSession)}/classes"
        a.withColumn("rings", F.sort_array("rings")).write.parquet(path)
        a = a.sparkSession.read.parquet(path)
    b = (a if same else ring_classes(right, "x", "y").drop("n")).withColumns(ends).toDF(*(f"b_{c}" for c in ("class", "rings", "parts", *names)))
    size, reach = 3 * tolerance, tolerance * (1 + 1e-9)
    a = a.withColumns(ends).withColumns({f"c_{n}": F.floor(F.col(n) / size) for n in names})
    close = F.lit(True)
    for n in names:
        b = b.withColumn(f"c_{n}", F.explode(cells(F.col(f"b_{n}") - reach, F.col(f"b_{n}") + reach, size)))
        close = close & (F.abs(F.col(n) - F.col(f"b_{n}")) <= tolerance)
    if same:
        close = close & ((F.col("class") < F.col("b_class")) | (F.col("class") == F.col("b_class")) & (F.size("rings") > 1))
    square = lambda v: v * v
    near = lambda p, others: F.array_min(F.transform(others, lambda q: square(p["x"] - q["x"]) + square(p["y"] - q["y"])))
    far = lambda one, two: F.array_max(F.transform(one, lambda p: near(p, two)))
    d = F.sqrt(F.greatest(far("parts", "b_parts"), far("b_parts", "parts")))
    pairs = shuffled(a).join(shuffled(b), [f"c_{n}" for n in names]).where(close).select("class", "rings", "b_class", "b_rings", d.alias("d")).where(F.col("d") <= most)
    if digits is not None:
        pairs = pairs.withColumn("d", F.round("d", digits))
    if not same:
        return pairs.select(F.explode("rings").alias("ring"), "b_rings", "d").select("ring", F.explode("b_rings").alias("b_ring"), "d")
    own = F.col("class") == F.col("b_class")
    pairs = pairs.select(F.posexplode("rings").alias("i", "one"), "*")
    pairs = pairs.select("one", F.explode(F.when(own, F.slice("rings", F.col("i") + 2, F.size("rings"))).otherwise(F.col("b_rings"))).alias("two"), "d")
    return pairs.select(F.least("one", "two").alias("ring"), F.greatest("one", "two").alias("b_ring"), "d")


def chord_pairs(places: DataFrame, radius: float) -> DataFrame:
    """a, b, d: places (id, lon, lat in degrees) whose chord through the ellipsoid is no longer than a
    radius in metres. Cells are cubes of the radius; of the 27 around a place the equi-join meets all."""
    s, c = F.sin(F.radians("lat")), F.cos(F.radians("lat"))
    n = AXIS / F.sqrt(1 - ECCENTRICITY2 * s * s)
    p = places.select("id", (n * c * F.cos(F.radians("lon"))).alias("x"), (n * c * F.sin(F.radians("lon"))).alias("y"), (n * (1 - ECCENTRICITY2) * s).alias("z"))
    cell = lambda v: F.floor(F.col(v) / radius)
    a = p.select("*", *(cell(v).alias(f"c{v}") for v in "xyz"))
    b = p.toDF("b_id", "bx", "by", "bz")
    for v in "xyz":
        b = b.withColumn(f"c{v}", F.explode(F.array(*(F.floor(F.col(f"b{v}") / radius) + o for o in (-1, 0, 1)))))
    d = F.sqrt(sum(((F.col(v) - F.col(f"b{v}")) * (F.col(v) - F.col(f"b{v}")) for v in "xyz"), F.lit(0.0)))
    return shuffled(a).join(shuffled(b), ["cx", "cy", "cz"]).where("id < b_id").withColumn("d", d).where(F.col("d") <= radius).select(F.col("id").alias("a"), F.col("b_id").alias("b"), "d")


def exact_quantiles(values: DataFrame, column: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """share, value: quantiles by linear interpolation, as percentile() gives them, without a task that
    holds all values. Equal values are counted first; the counts of equal-width bins, whose number is
    fixed, give the ranks before each bin, and ranks within a bin are found in the bin."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    placed = counts.join(F.broadcast(ends), F.lit(True))  # one row
    width = (F.col("high") - F.col("low")) / bins
    placed = placed.withColumn("bin", F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / width))).otherwise(0))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("bin").agg(F.sum("n").alias("k"))
    base = base.select("bin", F.coalesce(F.sum("k").over(ahead(Window.orderBy("bin"))), F.lit(0)).alias("base"))
    ranked = placed.join(F.broadcast(base), "bin")  # as many rows as bins
    first = F.col("base") + F.coalesce(F.sum("n").over(ahead(Window.partitionBy("bin").orderBy("v"))), F.lit(0))
    ranked = ranked.select("v", first.alias("first"), (first + F.col("n") - 1).alias("last"), "total")
    asked = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    at = F.col("share") * (F.col("total") - 1)
    hits = ranked.select("v", "first", "last", "total", asked).withColumn("at", at).where("last >= floor(at) AND first <= ceil(at)")
    low = F.max(F.when(F.expr("first <= floor(at) AND last >= floor(at)"), F.col("v")))
    high = F.max(F.when(F.expr("first <= ceil(at) AND last >= ceil(at)"), F.col("v")))
    part = F.first("at") - F.floor(F.first("at"))
    return hits.groupBy("share").agg((low * (1 - part) + high * part).alias("value"))


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Points (id, x, y; right b_id, bx, by; further columns stay) within a radius: 3 x 3 cells of its
    size. A third of the points that share these cells are within it, so even a dense cell costs what
    it yields."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = left.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    b = right.withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around))
    b = b.select(*right.columns, (F.floor(F.col("bx") / radius) + F.col("ox")).alias("cx"), (F.floor(F.col("by") / radius) + F.col("oy")).alias("cy"))
    d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    return shuffled(a).join(shuffled(b), ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius).drop("cx", "cy")


def ring_signature(points: Column) -> Column:
    """SHA-256 of a ring (array of x, y; not closed) free of its start and direction.

    The ring is turned to begin at its least vertex, then runs towards the lesser of the two
    neighbours; coordinates enter with nine decimals. If the least vertex
    repeats, the start is ambiguous, so callers leave such rings out.
    """
    n = F.size(points)
    at = F.array_position(points, F.array_min(points)).cast("int")
    ahead = F.concat(F.slice(points, at, n), F.slice(points, F.lit(1), at - 1))
    # From the least vertex on backwards: the rest of the ring reversed.
    back = F.concat(F.slice(ahead, 1, 1), F.reverse(F.slice(ahead, F.lit(2), n)))
    shown = F.transform(F.least(ahead, back), lambda p: F.format_string("%.9f %.9f", p["x"], p["y"]))
    return F.sha2(F.array_join(shown, ","), 256)
