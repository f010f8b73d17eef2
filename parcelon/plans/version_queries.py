"""Queries on two versions of a table, on multisets and fingerprints, and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import versions as V
from .fixtures import BOXES_SQL, T, boxes

QUERIES, SQL = {}, {}
#: The second version: some keys dropped, some values changed, some keys new.
_TWO = """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS prio FROM orders),
b AS (SELECT CASE WHEN k % 101 = 0 THEN k + 100000000 ELSE k END AS k, CASE WHEN k % 89 = 0 THEN 'X' ELSE status END AS status, CASE WHEN k % 83 = 0 THEN price + 1 ELSE price END AS price, prio FROM a WHERE k % 97 <> 0)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def two(spark, sf):
    a = T(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("prio"))
    k = F.col("k")
    b = a.where(k % 97 != 0).select(F.when(k % 101 == 0, k + 100000000).otherwise(k).alias("k"), F.when(k % 89 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(k % 83 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), "prio")
    return a, b


@query(_TWO + " SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' ELSE 'old' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def key_reconcile(spark, sf):
    return V.reconcile(*two(spark, sf), "k")


@query(_TWO + " SELECT a.k, a.status, b.status AS new_status FROM a LEFT JOIN b ON a.k = b.k")
def merge_one_to_one(spark, sf):
    a, b = two(spark, sf)
    return V.one_to_one(a.select("k", "status"), b.select("k", F.col("status").alias("new_status")), ["k"])


_MISS = "concat_ws(';', CASE WHEN a.status <> b.status THEN 'status' END, CASE WHEN a.price <> b.price THEN 'price' END, CASE WHEN a.prio <> b.prio THEN 'prio' END)"


@query(_TWO + f" SELECT a.k, {_MISS} AS fields FROM a JOIN b ON a.k = b.k WHERE {_MISS} <> ''")
def attr_mismatches(spark, sf):
    a, b = two(spark, sf)
    j = a.alias("a").join(b.alias("b"), "k")
    names = F.concat_ws(";", *(F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), c) for c in ("status", "price", "prio")))
    return j.select("k", names.alias("fields")).where("fields <> ''")


@query(_TWO + " SELECT a.k, CASE WHEN a.status <> b.status THEN a.status || '>' || b.status END AS status_change, round(b.price - a.price, 2) AS price_change FROM a JOIN b ON a.k = b.k WHERE a.status <> b.status OR a.price <> b.price")
def row_changes(spark, sf):
    a, b = two(spark, sf)
    j = a.alias("a").join(b.alias("b"), "k").where("a.status <> b.status OR a.price <> b.price")
    return j.select("k", F.when(F.col("a.status") != F.col("b.status"), F.concat("a.status", F.lit(">"), "b.status")).alias("status_change"), F.round(F.col("b.price") - F.col("a.price"), 2).alias("price_change"))


@query(_TWO + " SELECT count(*) AS keys, count(*) FILTER (WHERE a.status = b.status AND a.price = b.price) AS exact, round(sum(greatest(a.price - b.price, 0)), 2) AS lost, round(sum(greatest(b.price - a.price, 0)), 2) AS added FROM a JOIN b ON a.k = b.k")
def audit_totals(spark, sf):
    a, b = two(spark, sf)
    j = a.alias("a").join(b.alias("b"), "k")
    d = F.col("a.price") - F.col("b.price")
    return j.agg(F.count("*").alias("keys"), F.count_if((F.col("a.status") == F.col("b.status")) & (d == 0)).alias("exact"), F.round(F.sum(F.greatest(d, F.lit(0.0))), 2).alias("lost"), F.round(F.sum(F.greatest(-d, F.lit(0.0))), 2).alias("added"))


@query(_TWO + " SELECT round(min(b.price - a.price), 4) AS least, round(median(b.price - a.price), 4) AS middle, round(max(b.price - a.price), 4) AS most FROM a JOIN b ON a.k = b.k")
def difference_stats(spark, sf):
    a, b = two(spark, sf)
    d = F.col("b.price") - F.col("a.price")
    found = a.alias("a").join(b.alias("b"), "k").select(d.alias("d"))
    q = G.exact_quantiles(found, "d", [0.0, 0.5, 1.0])
    return q.agg(*(F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 4).alias(n) for n, s in (("least", 0.0), ("middle", 0.5), ("most", 1.0))))


@query(_TWO + " SELECT status, prio, count(*) AS n FROM (SELECT status, prio FROM a EXCEPT ALL SELECT status, prio FROM b) GROUP BY ALL")
def multiset_except(spark, sf):
    a, b = two(spark, sf)
    return a.select("status", "prio").exceptAll(b.select("status", "prio")).groupBy("status", "prio").agg(F.count("*").alias("n"))


@query(_TWO + " SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS equal")
def multiset_equal(spark, sf):
    a, b = two(spark, sf)
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.select(F.lit(1)).union(right.select(F.lit(1))).agg((F.count("*") == 0).alias("equal"))


@query(_TWO + " SELECT k, 'removed' AS what FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'new' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def holes_added_removed(spark, sf):
    a, b = (x.select("k") for x in two(spark, sf))
    return a.subtract(b).withColumn("what", F.lit("removed")).union(b.subtract(a).withColumn("what", F.lit("new")))


_FP = "CASE WHEN {c} IS NULL THEN 'n;' ELSE '{t}' || strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) || ';' END"
_ROW = lambda cols: "sha256(" + " || ".join(_FP.format(c=c, t=t) for c, t in cols.items()) + ")"
_ORDERS = {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_orderpriority": "s"}


@query(f"WITH h AS (SELECT {_ROW(_ORDERS)} AS h FROM orders), p AS (SELECT h[1:2] AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(h, '' ORDER BY p)) AS sha FROM p")
def fingerprint(spark, sf):
    return V.fingerprint(T(spark, sf, "orders"), _ORDERS)


@query(f"SELECT sha256(string_agg(h, '' ORDER BY n_nationkey)) AS sha FROM (SELECT n_nationkey, sha256(n_name) AS h FROM nation)")
def ordered_hash(spark, sf):
    h = T(spark, sf, "nation").select(F.struct("n_nationkey", F.sha2(F.col("n_name"), 256).alias("h")).alias("s"))
    return h.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["h"]), ""), 256).alias("sha"))


@query("SELECT n_nationkey, sha256(n_name) AS h FROM nation WHERE n_regionkey = 2")
def select_fingerprint(spark, sf):
    return T(spark, sf, "nation").where("n_regionkey = 2").select("n_nationkey", F.sha2(F.col("n_name"), 256).alias("h"))


@query(_TWO + " SELECT (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS same_count, (SELECT sum(k) FROM a) = (SELECT sum(k) FROM b) AS same_keys, (SELECT max(prio) FROM a) = (SELECT max(prio) FROM b) AS same_labels")
def layer_compare(spark, sf):
    a, b = two(spark, sf)
    part = lambda x, p: x.agg(F.count("*").alias(f"{p}n"), F.sum("k").alias(f"{p}k"), F.max("prio").alias(f"{p}l"))
    both = part(a, "a").crossJoin(part(b, "b"))  # one row each
    return both.select((F.col("an") == F.col("bn")).alias("same_count"), (F.col("ak") == F.col("bk")).alias("same_keys"), (F.col("al") == F.col("bl")).alias("same_labels"))


_SAME = lambda cols: f"(SELECT count(*) FROM (SELECT {cols} FROM a EXCEPT ALL SELECT {cols} FROM b)) + (SELECT count(*) FROM (SELECT {cols} FROM b EXCEPT ALL SELECT {cols} FROM a)) = 0"


@query(_TWO + f" SELECT (SELECT typeof(any_value((k, status, price, prio))) FROM a) = (SELECT typeof(any_value((k, status, price, prio))) FROM b) AS same_schema, (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS same_count, {_SAME('k, status, price, prio')} AS same_values, {_SAME('status, price, prio')} AS same_attributes, {_SAME('k')} AS same_keys, {_SAME('status')} AS same_status, {_SAME('price')} AS same_price, {_SAME('prio')} AS same_prio")
def layer_fingerprints(spark, sf):
    """Equality by fingerprints of the contents; layer_compare takes a count, a sum and a maximum."""
    return V.compare_layers(*two(spark, sf), "k")


@query("SELECT user_id AS owner, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def adjacent_sets(spark, sf):
    return T(spark, sf, "events").groupBy(F.col("user_id").alias("owner")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def type_partition(spark, sf):
    return T(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT 'gap-' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR), 7, '0') AS id, p_partkey FROM part")
def sequential_ids(spark, sf):
    """Numbers over a total order: offsets of ranges, then places within them; no single task."""
    t = T(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 4096).alias("b"))
    base = t.groupBy("b").agg(F.count("*").alias("n"))
    base = base.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    n = F.row_number().over(Window.partitionBy("b").orderBy("p_partkey")) + F.col("base")
    return t.join(base, "b").select(F.concat(F.lit("gap-"), F.lpad(n.cast("string"), 7, "0")).alias("id"), "p_partkey")


@query("SELECT p_type AS kind, arg_max(p_partkey, p_retailprice * 1000000 - p_partkey) AS best FROM part GROUP BY 1")
def argmax_class(spark, sf):
    return T(spark, sf, "part").groupBy(F.col("p_type").alias("kind")).agg(F.max_by("p_partkey", F.col("p_retailprice") * 1000000 - F.col("p_partkey")).alias("best"))


_VOID = """WITH w AS (SELECT p_partkey AS id, p_size % 3 AS sa, p_size // 3 % 3 AS ma, p_size // 9 % 2 AS sp, p_size // 18 % 2 AS mp, p_partkey % 4 AS zones, p_partkey % 50 = 0 AS empty FROM part),
x AS (SELECT id, CASE WHEN empty THEN 'undetermined' WHEN sa = 0 AND ma = 0 AND sp = 0 AND mp = 0 THEN 'source' WHEN sa > 0 AND ma > 0 AND sp > 0 AND mp > 0 THEN 'processing' ELSE 'undetermined' END AS cause,
CASE WHEN zones > 1 THEN 'between zones' ELSE 'inside one zone' END AS context, CASE WHEN zones > 1 OR sp > 0 THEN 'keep' ELSE 'confirm' END AS decision FROM w)"""


def voids(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    third = lambda n: F.floor(s / n)
    w = T(spark, sf, "part").select(k.alias("id"), (s % 3).alias("sa"), (third(3) % 3).alias("ma"), (third(9) % 2).alias("sp"), (third(18) % 2).alias("mp"), (k % 4).alias("zones"), (k % 50 == 0).alias("empty"))
    cause = F.when(F.col("empty"), "undetermined").when(F.expr("sa = 0 AND ma = 0 AND sp = 0 AND mp = 0"), "source").when(F.expr("sa > 0 AND ma > 0 AND sp > 0 AND mp > 0"), "processing").otherwise("undetermined")
    return w.select("id", cause.alias("cause"), F.when(F.col("zones") > 1, "between zones").otherwise("inside one zone").alias("context"), F.when(F.expr("zones > 1 OR sp > 0"), "keep").otherwise("confirm").alias("decision"))


@query(_VOID + " SELECT * FROM x")
def void_classify(spark, sf):
    """The decision table on coverage inside a void."""
    return voids(spark, sf)


@query(_VOID + " SELECT cause, context, count(*) AS n FROM x GROUP BY ALL")
def void_summary(spark, sf):
    return voids(spark, sf).groupBy("cause", "context").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size AS area, p_retailprice AS aspect FROM part), s AS (
SELECT id, 1 AS o FROM (SELECT id FROM r ORDER BY area DESC, id LIMIT 2) UNION ALL SELECT id, 2 FROM (SELECT id FROM r WHERE area >= 1 ORDER BY aspect DESC, id LIMIT 2) UNION ALL SELECT id, 3 FROM (SELECT id FROM r WHERE id % 7 = 3 ORDER BY area DESC, id LIMIT 1))
SELECT id, CAST(min(o) AS INTEGER) AS picked_by FROM s GROUP BY id""")
def representatives(spark, sf):
    """Top rows by several criteria; the first criterion that picks a row counts."""
    r = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("area"), F.col("p_retailprice").alias("aspect"))
    pick = lambda d, by, n, o: d.orderBy(F.desc(by), "id").limit(n).select("id", F.lit(o).alias("o"))
    return pick(r, "area", 2, 1).union(pick(r.where("area >= 1"), "aspect", 2, 2)).union(pick(r.where("id % 7 = 3"), "area", 1, 3)).groupBy("id").agg(F.min("o").alias("picked_by"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_by_name(spark, sf):
    a = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(T(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query(f"WITH {BOXES_SQL} SELECT brand, round(sum((xmax - xmin) * (ymax - ymin)), 4) AS before, round(sum((xmax - xmin) * greatest(ymax - ymin - 0.1, 0)), 4) AS after, round(max(abs((xmax - xmin) * (ymax - ymin) - (xmax - xmin) * greatest(ymax - ymin - 0.1, 0))), 6) AS most FROM box GROUP BY brand")
def area_delta(spark, sf):
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    cut = w * F.greatest(h - 0.1, F.lit(0.0))
    return boxes(spark, sf).groupBy("brand").agg(F.round(F.sum(w * h), 4).alias("before"), F.round(F.sum(cut), 4).alias("after"), F.round(F.max(F.abs(w * h - cut)), 6).alias("most"))


@query(_TWO + " SELECT count(*) FILTER (WHERE TRY_CAST(substr(prio, 1, 1) AS BIGINT) IS NOT NULL) AS whole, count(*) AS n FROM a")
def attr_equal(spark, sf):
    a, _ = two(spark, sf)
    return a.agg(F.count_if(F.substring("prio", 1, 1).try_cast("long").isNotNull()).alias("whole"), F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark, sf):
    return T(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
