"""Ordered rule tables: the first matching rule wins.

A rule has attribute fields (blank: any value), an optional code and optional closed bounds of a
point. `classify` compiles the rules into one CASE chain, which stays within code generation and
keeps the order lazily; `classify_join` joins a rules table instead, for tables too long for that.
Both fail where a rule that matches by name needs a code or a point that the record lacks, unless an
earlier rule has matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = ["prefecture", "subprefecture", "county", "municipality"]
BOUNDS = ["lon_min", "lon_max", "lat_min", "lat_max"]


def attributes_match(rule: dict) -> Column:
    """Blank fields match anything; a rule with a code needs the record's code."""
    tests = [F.coalesce(a, F.lit("")) == rule[a] for a in ATTRIBUTES if rule.get(a)]
    found = reduce(lambda a, b: a & b, tests, F.lit(True))
    if rule.get("code"):
        missing = F.raise_error(F.lit(f"rule {rule['rule_id']} needs a code")).cast("boolean")
        found = found & F.when(F.coalesce("code", F.lit("")) == "", missing).otherwise(F.col("code") == rule["code"])
    return found


def bounds_match(rule: dict, lon: Column, lat: Column) -> Column:
    tests = [test for name, value, low in (("lon_min", lon, True), ("lon_max", lon, False), ("lat_min", lat, True), ("lat_max", lat, False)) if rule.get(name) is not None for test in [value >= rule[name] if low else value <= rule[name]]]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def has_bounds(rule: dict) -> bool:
    return any(rule.get(b) is not None for b in BOUNDS)


def classify(records: DataFrame, rules: list[dict], output: str = "zone", value: str = "zone") -> DataFrame:
    """Adds the value of the first rule that matches; a rule with bounds fails on a missing point."""
    chain = None
    for rule in sorted(rules, key=lambda r: r["rule_id"]):
        test = attributes_match(rule)
        if has_bounds(rule):
            missing = F.raise_error(F.lit(f"rule {rule['rule_id']} needs a point")).cast("boolean")
            test = test & F.when(F.col("lon").isNull() | F.col("lat").isNull(), missing).otherwise(bounds_match(rule, F.col("lon"), F.col("lat")))
        chain = F.when(test, rule[value]) if chain is None else chain.when(test, rule[value])
    return records.withColumn(output, chain.cast("int"))


#: Rules that a theta join sends to every task; a longer table meets the records by the attribute
#: in which its rules differ most.
BROADCAST_RULES = 10_000


def classify_join(records: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key, zone of each record, as classify() gives it, by a join with a rules table."""
    r = rules.select(*(F.col(c).alias(f"r_{c}") for c in rules.columns))
    row = "_row"
    numbered = records.withColumn(row, F.monotonically_increasing_id())
    wild = lambda a: (F.col(f"r_{a}") == "") | (F.col(f"r_{a}") == F.coalesce(a, F.lit("")))
    on = reduce(lambda a, b: a & b, map(wild, ATTRIBUTES))
    if rules.count() <= BROADCAST_RULES:
        met = numbered.join(F.broadcast(r), on)
    else:
        # Rules with a blank field meet the records by a blank of their own.
        most = max(ATTRIBUTES, key=lambda a: rules.select(a).distinct().count())
        either = numbered.withColumn("_met", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce(most, F.lit(""))))))
        met = either.join(r, (F.col("_met") == F.col(f"r_{most}")) & on)
    named = F.col("r_code") != ""
    coded = F.coalesce("code", F.lit(""))
    low = lambda n, v: F.col(n).isNull() | (v >= F.col(n))
    high = lambda n, v: F.col(n).isNull() | (v <= F.col(n))
    bounded = reduce(lambda a, b: a | b, (F.col(f"r_{b}").isNotNull() for b in BOUNDS))
    within = low("r_lon_min", F.col("lon")) & high("r_lon_max", F.col("lon")) & low("r_lat_min", F.col("lat")) & high("r_lat_max", F.col("lat"))
    verdict = (
        F.when(named & (coded == ""), "code")
        .when(named & (coded != F.col("r_code")), None)
        .when(bounded & (F.col("lon").isNull() | F.col("lat").isNull()), "point")
        .when(~bounded | within, "")
    )
    hits = met.withColumn("_need", verdict).where("_need IS NOT NULL")
    first = hits.groupBy(row).agg(F.min(F.struct("r_rule_id", "r_zone", "_need")).alias("_first"))
    fails = F.raise_error(F.concat(F.lit("rule "), F.col("_first.r_rule_id").cast("string"), F.lit(" needs a "), F.col("_first._need"))).cast("int")
    zone = F.when(F.col("_first._need") != "", fails).otherwise(F.col("_first.r_zone").cast("int"))
    return numbered.join(first, row, "left").select(key, zone.alias("zone"))


def split_boxes(boxes: DataFrame, rules: list[dict]) -> DataFrame:
    """For boxes (xmin, ymin, xmax, ymax): the zones of the cells that the bounds of all rules with
    matching attributes cut them into, and the lines that cut them.

    A line cuts strictly inside a box; the centre of a cell decides its zone.
    """

    def lines(axis: str, low: str, high: str) -> Column:
        values = []
        for rule in rules:
            for name in (f"{axis}_min", f"{axis}_max"):
                if rule.get(name) is not None:
                    line = F.lit(float(rule[name]))
                    values.append(F.when(attributes_match(rule) & (F.col(low) < line) & (F.col(high) > line), line))
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*values)))) if values else F.array().cast("array<double>")

    cut = boxes.withColumn("xs", lines("lon", "xmin", "xmax")).withColumn("ys", lines("lat", "ymin", "ymax"))
    edges = cut.withColumn("ex", F.concat(F.array("xmin"), "xs", F.array("xmax"))).withColumn("ey", F.concat(F.array("ymin"), "ys", F.array("ymax")))
    middle = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: (F.get(F.col(e), i) + F.get(F.col(e), i + 1)) / 2)
    cells = edges.withColumn("lon", F.explode(middle("ex"))).withColumn("lat", F.explode(middle("ey")))
    return classify(cells, rules)
