"""Document fingerprints by consistent weighted sampling (DataFrame operations only).

A document is the weighted set of its terms (as split at white space, upper and lower case kept
apart), a term's weight being how often it occurs. Sample k
draws for each term two gamma(2, 1) variates r, c and a uniform b from hashes of the term alone;
with t = floor(ln(weight) / r + b), the term with the least ln(c) - r * (t - b + 1) is the sample,
and (term, t) its value. Two documents have equal samples with a probability equal to their
generalised Jaccard similarity, sum of minima over sum of maxima, so the share of equal samples
estimates it.

Documents are dealt once, by runs of their order, to buckets of bounded bytes, and written as a
table by them; everything after that (the next document, terms, weights, samples) reads that table
and needs no further shuffle of texts. Within a
bucket the samples of a term and weight are drawn once, whatever the number of documents. The runs
are found on ids, hashes and sizes alone: ranges of ids with too many bytes are split, by the ids
that they hold, until each fits, so that neither outliers nor clusters of ids make a large bucket.

An estimate from 32 samples has a standard error of up to 0.09 (0.5 / sqrt(32)); values of 16 bits
agree by chance once in 65,536.

Defined cases: a null text is empty; a text of any length is taken whole, and is a bucket of its own
if it is larger than one; a document without terms has samples of its own kind, equal
to each other and to no other document's; documents are ordered by doc_id, descending, null ids
last, equal ids by a hash of the text and then the text; a single document is its own next one;
repeated rows stay apart and have equal fingerprints; an empty table gives no rows; further columns
are ignored. While the samples are drawn, the options in SETTINGS hold for the whole session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import parts_for, running_total, shared_dir, table, text_of, written

SAMPLES = 32
#: Text bytes for a bucket, and ranges of ids that are tried for each bucket.
BUCKET_BYTES = 4 << 20
CELLS = 16
#: So many bits of child numbers lie in one row of the owners. Owners and rules are broadcast whatever
#: their size, as a join without that shuffles the texts once more; they have a few rows for a bucket.
RANGE_BITS = 6
#: Spark's default limit on the buckets of a table; beyond it a file holds several of ours.
MOST_FILES = 100_000
#: For the stage that draws samples. Methods of more than 8000 bytes are never compiled by the
#: JVM, so Spark shall split them; terms that lie sorted are grouped in one pass, without hash tables.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.execution.replaceHashWithSortAgg": "true"}


def unit(x: Column, shift: int, bits: int) -> Column:
    """A uniform variate above 0 and up to 1 from some bits of a hash."""
    return (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 1).cast("double") / float(1 << bits)


def sample(term: Column, weight_ln: Column, k: int) -> Column:
    """The packed k-th sample of a term: order in the high bits, value in the low 16."""
    x, y = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(unit(x, 32, 32) * unit(x, 0, 32))
    c = -F.ln(unit(y, 40, 24) * unit(y, 16, 24))
    # Both products can round to 1; a least variate keeps the logarithms finite.
    r, c = F.greatest(r, F.lit(1e-12)), F.greatest(c, F.lit(1e-12))
    b = F.shiftrightunsigned(y, 0).bitwiseAND(F.lit(0xFFFF)).cast("double") / 65536.0
    t = F.floor(weight_ln / r + b)
    order = ((F.ln(c) - r * (t - b + 1) + 4096.0) * float(1 << 30)).cast("long")
    return F.shiftleft(order, 16).bitwiseOR(F.xxhash64(term, t, F.lit(k)).bitwiseAND(F.lit(0xFFFF)))


def split_rules(stats: DataFrame, bits: Column, limit: int) -> DataFrame:
    """How nodes split. A node is a range of the order: a path of child numbers. It splits by ids
    (by: k), or if it has one id only by hashes of texts (g), at a power of two that gives up to
    2 ** bits children; copies of one id and text are dealt in turn (by: copies, so many children)."""
    span = lambda c: F.expr(f"ceil(log2(cast(shiftright({c}1, 1) - shiftright({c}0, 1) AS double) + 1)) + 1")
    by = F.when(F.col("k0").isNotNull() & ((F.col("k0") < F.col("k1")) | (F.col("nulls") > 0)), "k").when(F.col("g0") < F.col("g1"), "g").otherwise("copies")
    rules = stats.withColumn("by", by).withColumn("span", F.when(F.col("by") == "k", span("k")).otherwise(span("g"))).withColumn("bits", bits)
    rules = rules.withColumn("shift", F.greatest(F.lit(0), F.col("span") - F.col("bits")).cast("int"))
    base = F.when(F.col("by") == "k", F.expr("shiftright(k0, shift)")).when(F.col("by") == "g", F.expr("shiftright(g0, shift)"))
    children = F.least("n", F.ceil(2 * F.col("bytes") / limit)).cast("long")
    return rules.select("node", "by", "shift", base.alias("base"), F.when(F.col("by") == "copies", children).alias("children"), "bytes")


def descended(rows: DataFrame, rules: DataFrame, copies: bool) -> DataFrame:
    """rows (k, g, node) with each node that has a rule replaced by its child. Copies of a row are
    alike, so it does not matter which of them takes which turn. Rules are fewer than buckets."""
    return stepped(rows.join(F.broadcast(rules.drop("bytes")), "node", "left"), copies).drop("by", "shift", "base", "children")


def descended_root(rows: DataFrame, rules: DataFrame, copies: bool) -> DataFrame:
    """As descended(), for the rule of the root: one row, which enters as values, not as a join."""
    rule = rules.first()
    values = [F.lit(rule[n]).cast(t).alias(n) for n, t in (("by", "string"), ("shift", "int"), ("base", "long"), ("children", "long"))]
    return stepped(rows.select("*", *values), copies).drop("by", "shift", "base", "children")


def stepped(rows: DataFrame, copies: bool) -> DataFrame:
    null_child = F.lit(1 << 62)  # null ids follow all others
    child = F.when(F.col("by") == "k", F.coalesce(F.expr("shiftright(k, shift)") - F.col("base"), null_child)).when(F.col("by") == "g", F.expr("shiftright(g, shift)") - F.col("base"))
    if copies:
        child = child.otherwise(F.pmod(F.monotonically_increasing_id(), F.col("children")))
    return rows.withColumn("node", F.when(F.col("by").isNull(), F.col("node")).otherwise(F.concat("node", F.array(child))))


def deal(keys: DataFrame, limit: int, cells: int, folder: str) -> tuple[list[tuple[DataFrame, bool]], DataFrame]:
    """Rules level by level (and if they deal copies), and the leaves (node, bytes): no leaf has more than `limit` bytes, unless
    one row has. keys: k and g (ascending in the order of documents, null k last), bytes."""
    active, rules, leaves, level = keys.withColumn("node", F.array().cast("array<long>")), [], [], 0
    while True:
        low_high = [f(c).alias(f"{c}{i}") for c in "kg" for i, f in ((0, F.min), (1, F.max))]
        stats = active.groupBy("node").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("nulls"), *low_high)
        stats = written(stats, folder, f"nodes-{level}")
        over = (F.col("bytes") > limit) & (F.col("n") > 1)
        leaves.append(stats.where(~over).select("node", "bytes"))
        bits = F.ceil(F.log2(F.lit(float(2 * cells)))) if level == 0 else F.ceil(F.log2(4.0 * F.col("bytes") / limit))
        made = written(split_rules(stats.where(over), bits, limit), folder, f"rules-{level}")
        if not made.head(1):
            break
        copies = made.where("by = 'copies'")
        rules.append((made, bool(copies.head(1))))
        copies = copies.withColumn("child", F.explode(F.sequence(F.lit(0).cast("long"), F.col("children") - 1)))
        leaves.append(copies.select(F.concat("node", F.array("child")).alias("node"), F.ceil(F.col("bytes") / F.col("children")).alias("bytes")))
        split = made.where("by <> 'copies'")
        if level:
            active = descended(active.join(split.select("node"), "node", "left_semi"), split, False)
        else:
            active = descended_root(active, split, False) if split.head(1) else active.where("false")
        active = written(active, folder, f"active-{level}")
        level += 1
    every = leaves[0]
    for more in leaves[1:]:
        every = every.union(more)
    return rules, every


def place() -> list[Column]:
    """Of a node: its parent, its child number and the range of child numbers with this one. The root,
    which is a leaf only if there is no other, has 0."""
    child = F.coalesce(F.get("node", F.size("node") - 1), F.lit(0).cast("long"))
    parent = F.slice("node", 1, F.greatest(F.lit(0), F.size("node") - 1))
    return [parent.alias("parent"), F.shiftright(child, RANGE_BITS).alias("range"), child.alias("child")]


def owned(leaves: DataFrame) -> DataFrame:
    """leaves (node, b) by ranges of child numbers: starts has the first child of each b. As b ascends
    with the leaves, that of a leaf is the last one that starts at it or before."""
    starts = leaves.select("b", *place()).groupBy("parent", "range", "b").agg(F.min("child").alias("child"))
    return starts.groupBy("parent", "range").agg(F.sort_array(F.collect_list(F.struct("child", "b"))).alias("starts"))


def bucketed(docs: DataFrame, bucket_bytes: int, text: str, key: str, folder: str) -> tuple[DataFrame, int]:
    """doc_id, text, h, b, and the number of buckets: b, from 0 on without gaps, is ascending in the
    descending order of documents."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    # Ascending keys of the descending order; the complement never overflows.
    k, g = F.bitwise_not("doc_id").alias("k"), F.bitwise_not("h").alias("g")
    keys = written(rows.select(k, g, (F.octet_length("text") + 64).cast("long").alias("bytes")), folder, "keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    buckets = parts_for(total, bucket_bytes)
    rules, leaves = deal(keys, bucket_bytes, CELLS * buckets, folder)
    # Leaves in their order fill buckets; numbers that no bucket has drop out.
    filled = running_total(leaves, "node", "bytes", "before", folder, "leaves").select("node", F.floor(F.col("before") / bucket_bytes).alias("raw"))
    filled = written(filled, folder, "filled")
    numbers = running_total(filled.select("raw").distinct().withColumn("one", F.lit(1)), "raw", "one", "b", folder, "numbers").drop("one")
    owners = written(owned(filled.join(numbers, "raw").select("node", F.col("b").cast("int").alias("b"))), folder, "owners")
    placed = rows.withColumn("k", k).withColumn("g", g).withColumn("node", F.array().cast("array<long>"))
    for level, (rule, copies) in enumerate(rules):
        placed = (descended if level else descended_root)(placed, rule, copies)
    many = min(MOST_FILES, max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    b = F.element_at(F.filter("starts", lambda x: x["child"] <= F.col("child")), -1)["b"].alias("b")
    dealt = placed.select("doc_id", "text", "h", *place()).join(F.broadcast(owners), ["parent", "range"]).select("doc_id", "text", "h", b).repartition(many, "b")
    # Left as an exchange, each later use would shuffle the texts again, and all of these stay on disk.
    return common.bucketed(dealt, folder, "dealt", "b", many, "zstd"), numbers.count()


def heads(rows: DataFrame, place: str, buckets: int, *columns: str) -> DataFrame:
    """For each bucket: what the first document of the next bucket (after the last: the first) holds."""
    first = rows.where(F.col(place) == 1)
    return first.select(F.pmod(F.col("b") - 1, F.lit(max(1, buckets))).alias("b"), *(F.col(c).alias(f"head_{c}") for c in columns))


def edited_texts(rows: DataFrame, buckets: int, folder: str) -> DataFrame:
    """b, rn, doc_id, text, edited: a third of the text replaced by the next document's start."""
    order = Window.partitionBy("b").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    ranked = rows.withColumn("rn", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    # The first document of each bucket is a maximum of whole rows, found where they lie: a join with
    # the maxima would take their ids and hashes as keys too, and so shuffle all texts.
    top = rows.groupBy("b").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "h", "text")).alias("top"))
    first = written(top.select("b", F.col("top.text").alias("text"), F.lit(1).alias("one")), folder, "heads")
    joined = ranked.join(heads(first, "one", buckets, "text").hint("merge"), "b")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    following = F.coalesce("next_text", "head_text")
    return joined.select("b", "rn", "doc_id", "text", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(following, F.lit(1), cut)).alias("edited"))


def fingerprint_rows(texts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """texts: b, rn, text, edited. Returns b, rn, fp and efp: arrays of 16-bit values, null without terms.

    Both texts begin alike. The whole words of that beginning are split and counted once, and a
    term of equal weight in both texts is sampled once (kind 2) for the two.
    """
    cut = F.length("text") - F.floor(F.length("text") / 3).cast("int")
    head = F.regexp_extract(F.substring(F.col("text"), F.lit(1), cut), r"(?s)^(.*\s)", 1)
    parts = texts.withColumn("head", head)
    rest = lambda c: F.substring(F.col(c), F.length("head") + 1, F.length(c))
    three = F.array(F.struct(F.lit(2).alias("kind"), F.col("head").alias("t")), F.struct(F.lit(0).alias("kind"), rest("text").alias("t")), F.struct(F.lit(1).alias("kind"), rest("edited").alias("t")))
    terms = parts.select("b", "rn", F.explode(three).alias("v")).select("b", "rn", "v.kind", F.explode(F.split("v.t", r"\s+")).alias("term")).where("term <> ''")
    count = lambda other: F.count_if(F.col("kind") != other)
    weights = terms.groupBy("b", "rn", F.xxhash64("term").alias("x")).agg(count(1).alias("own"), count(0).alias("new"))
    told = lambda kind, tf: F.struct((F.col("rn") * 4 + kind).alias("d"), F.col(tf).alias("tf"))
    own, new = told(0, "own"), told(1, "new")
    kinds = F.when(F.col("own") == F.col("new"), F.array(told(2, "own"))).when(F.col("new") == 0, F.array(own)).when(F.col("own") == 0, F.array(new)).otherwise(F.array(own, new))
    pairs = weights.select("b", "x", F.explode(kinds).alias("k")).select("b", "x", "k.d", "k.tf")
    # x comes first, as its leading bits decide nearly all comparisons of the sort.
    shared = pairs.sortWithinPartitions("x", "tf", "b").groupBy("x", "tf", "b").agg(F.collect_list("d").alias("in"))
    drawn = shared.select("b", "in", "x", F.ln(F.col("tf").cast("double")).alias("w"))
    drawn = drawn.select("b", "in", F.array(*(sample(F.col("x"), F.col("w"), k) for k in range(samples))).alias("s"))
    each = drawn.select("b", "s", F.explode("in").alias("d"))
    least = each.groupBy("b", "d").agg(*(F.min(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(samples)))
    least = least.select("b", F.floor(F.col("d") / 4).cast("int").alias("rn"), (F.col("d") % 4).alias("kind"), F.array(*(F.col(f"s{k}") for k in range(samples))).alias("s"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("s"))).alias(f"k{kind}")
    both = least.groupBy("b", "rn").agg(of(0), of(1), of(2))

    def joined(kind: str) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.least(F.get(F.col(kind), i), F.get(F.col("k2"), i)).bitwiseAND(F.lit(0xFFFF)))
        return F.when(F.col(kind).isNotNull() | F.col("k2").isNotNull(), every)

    return both.select("b", "rn", joined("k0").alias("fp"), joined("k1").alias("efp"))


def shown(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v), 4, "0")), ""))


def likeness(a: str, b: str, samples: int) -> Column:
    """Share of equal samples; documents without terms are alike each other only."""
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, k: n + (F.substring(a, 4 * k + 1, F.lit(4)) == F.substring(b, 4 * k + 1, F.lit(4))).cast("int"))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(equal / F.lit(float(samples)))


def fingerprints(docs: DataFrame, folder: str | None = None, samples: int = SAMPLES, bucket_bytes: int = BUCKET_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    dealt, buckets = bucketed(docs, bucket_bytes, text, key, folder)
    rows = edited_texts(dealt, buckets, folder)
    made = fingerprint_rows(rows.select("b", "rn", "text", "edited"), samples)
    pair = made.select("b", "rn", shown(F.col("fp")).alias("fp"), shown(F.col("efp")).alias("efp"))
    base = rows.select("b", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        kept = base.join(pair, ["b", "rn"], "left").select("b", "rn", "doc_id", "n_chars", "edited_sha256", F.coalesce("fp", F.lit("")).alias("fp"), F.coalesce("efp", F.lit("")).alias("efp"))
        kept = written(kept, folder, "fingerprints")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = Window.partitionBy("b").orderBy("rn")
    after = kept.withColumn("next_fp", F.lead("fp").over(order)).join(heads(kept, "rn", buckets, "fp").hint("merge"), "b").withColumn("next_fp", F.coalesce("next_fp", "head_fp"))
    return after.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), likeness("fp", "efp", samples).alias("near_edited"), likeness("fp", "next_fp", samples).alias("near_next"))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
