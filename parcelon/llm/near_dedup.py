"""MinHash near-dedup with odd sketches.

A document's set is its distinct five-word shingles. Documents of equal word sequences form a class
at once (and so have equal sets); below, only one document of each class goes on. MINHASHES samples of a set make BANDS band keys, and are
folded into a parity bitmap, the odd sketch: the population count of the XOR of two sketches
estimates how many samples differ, precisely for high similarities. Candidates of a band key are
verified by sketch first and then, always, on the full sets.

Pairs within a key are never all made. In the first round each member meets the least member of
its key only; the links found join most of a large group into one component. In later rounds
keys whose members still lie in several components compare the sketches of members of different
components: members outside a key's largest component are sent to every part of the key, members
of the largest to one part each, so that each pair of different components meets and a large group
is spread over many tasks. A pair is a candidate in the first key that it shares only, and at
first only the most similar candidates of a document are confirmed: mostly they join it to the
component, which then needs no other pair. The last round confirms all that are left.

Four samples a band and 32 bands miss a pair of similarity 0.85 with a probability of 6e-11, and
the bound on the sketches is five standard deviations from what 0.85 gives: it misses one with 8e-7.

Defined cases: a null, empty or blank text has an empty set, its own component, and is kept; a
text of fewer words than a shingle has one shingle, the whole sequence; a text of any length is
taken whole. Rows are documents of their own, also those that share a doc_id or have none: they are
linked by their texts only. A component's id is the least doc_id in it, null if all are null, and
the rows with that id are kept (with `row`, exactly one row of each component is). An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, parts_for, shared_dir, table, text_of, written
from .components import components

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 32, 4
#: Samples; the first BANDS * ROWS of them make the bands, all of them the sketch.
MINHASHES = 384
#: Longs in an odd sketch, and most odd bits that two sets of PERCENT differ in (five sigma).
SKETCH_LONGS = 24
SKETCH_BITS = 170
#: Members of a key that meet in one part, and rows (members and those that visit them) for a task.
PART_ROWS = 1000
TASK_ROWS = 8000
#: Candidates that a document outside its key's largest component sends on in each round; the
#: last round has no limit, so that no pair of different components stays unseen.
ROUNDS = (2, None)

_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(0, 1 << 63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, MINHASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: str) -> list[bytes]:
    """Lower-cases A-Z and splits at space and 0x09-0x0D, both on the bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a document's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    if len(h) < size:  # the whole sequence, told apart from a shingle by its length
        total = np.array([len(h)], np.uint64)
        for i in range(len(h)):
            total = total * _STEP + h[i : i + 1]
    else:
        total = h[:n].copy()
        for i in range(1, size):
            total = total * _STEP + h[i : i + n]
    return np.unique(mixed(total))


def shingle_set(words: list[bytes], size: int = SHINGLE) -> set:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def linked(a: str, b: str, percent: int = PERCENT) -> bool:
    x, y = shingle_set(words_of(a)), shingle_set(words_of(b))
    both = len(x & y)
    return bool(x) and bool(y) and 100 * both >= percent * (len(x) + len(y) - both)


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(MINHASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[i : i + 1024, None] * _A + _B).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of (documents, MINHASHES) samples; a key belongs to its band only."""
    parts = low[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mixed(key * _STEP + parts[:, :, i])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """(documents, SKETCH_LONGS) parity bitmaps of the samples with their numbers."""
    bits = 64 * SKETCH_LONGS
    where = (mixed(low + np.arange(MINHASHES, dtype=np.uint64) * _STEP) % np.uint64(bits)).astype(np.int64)
    flat = (np.arange(len(low))[:, None] * bits + where).reshape(-1)
    odd = (np.bincount(flat, minlength=len(low) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(low), bits), axis=1).view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """row, doc_id, text to row, doc_id, n_shingles, digest (of the word sequence; null for empty
    sets), bands, odd."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, digests, lows = [], [], []
                for t in part.column(2).to_pylist():
                    words = words_of(t)
                    found = shingle_hashes(words, known)
                    counts.append(len(found))
                    digests.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                    lows.append(minhash(found))
                low = np.array(lows, np.uint64)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(low).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
                odd = pa.FixedSizeListArray.from_arrays(pa.array(odd_sketch(low).reshape(-1)), SKETCH_LONGS).cast(pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), bands, odd], ["row", "doc_id", "n_shingles", "digest", "bands", "odd"])

    return rows.mapInArrow(make, "row long, doc_id long, n_shingles long, digest binary, bands array<long>, odd array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts: node, text."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            held = [(a, b) for a, b, x, y in zip(*cols, strict=True) if linked(x, y)]
            yield pa.record_batch([pa.array([p[i] for p in held], pa.int64()) for i in (0, 1)], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(check, "a long, b long")


def near_bits(x: str, y: str):
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_LONGS)), F.lit(0))


def sizes_fit(x: str, y: str):
    """Sets whose sizes alone do not rule a link out."""
    return (100 * F.col(x) >= PERCENT * F.col(y)) & (100 * F.col(y) >= PERCENT * F.col(x))


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def cross_pairs(limit: int | None):
    """Candidate pairs of different components of the same key and part, by size and sketch."""

    def find(group: pa.Table) -> pa.Table:
        col = {n: group.column(n).to_numpy() for n in ("key", "part", "node", "root", "n_shingles", "home", "minor")}
        wide = lambda name, kind: np.array(group.column(name).combine_chunks().flatten().to_numpy(), kind).reshape(len(group), -1)
        odd, sig = wide("odd", np.int64).view(np.uint64), wide("sig", np.int32)
        node, root, size = col["node"], col["root"], col["n_shingles"]
        order = np.lexsort((col["part"], col["key"]))
        cut = np.flatnonzero((np.diff(col["key"][order]) != 0) | (np.diff(col["part"][order]) != 0)) + 1
        found = set()
        for run in np.split(order, cut) if len(order) else []:
            home = run[col["home"][run]]
            for i in run[col["minor"][run]]:
                rest = home[root[home] != root[i]]
                rest = rest[(100 * size[i] >= PERCENT * size[rest]) & (100 * size[rest] >= PERCENT * size[i])]
                bits = np.bitwise_count(odd[rest] ^ odd[i]).sum(axis=1)
                near = bits <= SKETCH_BITS
                rest, bits = rest[near], bits[near]
                # The band of this key; pairs that agree in an earlier one meet there.
                band = int(np.argmax(sig[i] == np.int32(col["key"][i] & 0x7FFFFFFF)))
                first = ~(sig[rest, :band] == sig[i, :band]).any(axis=1)
                rest, bits = rest[first], bits[first]
                if limit is not None and len(rest) > limit:
                    rest = rest[np.argsort(bits, kind="stable")[:limit]]
                found.update((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))) for j in rest)
        pairs = sorted(found)
        return pa.table({"a": pa.array([x[0] for x in pairs], pa.int64()), "b": pa.array([x[1] for x in pairs], pa.int64())})

    return find


def near_dedup(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. With `row`, a column of a written table that
    numbers its rows, the result has it too, as "row", and one row of each component is kept: of
    those with the least key the one with the least number."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows = docs.select(*([] if row is None else [F.col(row).cast("long").alias("row")]), F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    if row is None:
        rows = numbered(rows, folder).select("row", "doc_id", "text")
    made = written(sketches(rows), folder, "sketches")
    # The least document of a class is its node: by id, then by row; null ids come last.
    order = lambda doc, at: F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc_id"), F.col(at).alias("row"))
    classes = made.where("digest IS NOT NULL").groupBy("digest").agg(F.min(order("doc_id", "row")).alias("first"))
    classes = written(classes.select("digest", F.col("first.row").alias("node"), F.col("first.doc_id").alias("node_id")), folder, "classes")
    nodes = made.join(classes.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi")
    nodes = written(nodes.select(F.col("row").alias("node"), "n_shingles", "bands", "odd"), folder, "nodes")
    # First round: each member of a key with the key's least member.
    held = nodes.select("node", F.explode("bands").alias("key"))
    keys = held.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1")
    members = written(held.join(keys, "key"), folder, "members")
    # Texts of nodes that share a key move once, and alike at every size.
    sharing = members.select(F.col("node").alias("n")).distinct()
    texts = rows.select(F.col("row").alias("node"), "text")
    texts = written(texts.join(sharing.hint("merge"), F.col("node") == F.col("n"), "left_semi"), folder, "texts")
    pairs = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    slim = nodes.select("node", "n_shingles", "odd")
    pairs = pairs.join(slim.toDF("a", "na", "oa"), "a").join(slim.toDF("b", "nb", "ob"), "b")
    pairs = pairs.where(sizes_fit("na", "nb") & (near_bits("oa", "ob") <= SKETCH_BITS)).select("a", "b")
    # Texts of nodes with a candidate only, found by a join of ids; the pairs come from a table.
    pairs = written(pairs, folder, "first-pairs")
    links = written(confirmed(pairs, wanted(texts, pairs)), folder, "first-links")
    roots = components(links, folder, "first")

    # Later rounds: members of the same key that still lie in different components.
    low = F.transform("bands", lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    sketch = nodes.select("node", "n_shingles", "odd", low.alias("sig"))
    tried = pairs
    for turn, limit in enumerate(ROUNDS, 2):
        placed = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = written(placed, folder, f"placed-{turn}")
        per = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        open_keys = per.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1")
        parts = F.ceil(F.col("total") / PART_ROWS).cast("int")
        # Members of the largest component lie in one part, all others visit every part.
        sent = F.col("top.n") + (F.col("total") - F.col("top.n")) * parts
        open_keys = written(open_keys.select("key", F.col("top.root").alias("major"), parts.alias("parts"), sent.alias("sent")), folder, f"open-{turn}")
        tasks = parts_for(open_keys.agg(F.sum("sent")).first()[0], TASK_ROWS)
        rows = placed.join(open_keys.drop("sent"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
        rows = rows.withColumn("minor", F.col("root") != F.col("major"))
        rows = rows.withColumn("part", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
        rows = rows.select("key", "part", "node", "root", (F.col("part") == F.col("own")).alias("home"), "minor").join(sketch, "node")
        rows = rows.withColumn("task", F.pmod(F.xxhash64("key", "part"), F.lit(tasks))).repartition(tasks, "task")
        found = rows.groupBy("task").applyInArrow(cross_pairs(limit), _PAIR)
        more = written(found.distinct().join(tried, ["a", "b"], "left_anti"), folder, f"pairs-{turn}")
        extra = written(confirmed(more, wanted(texts, more)), folder, f"links-{turn}")
        tried = tried.union(more)
        if extra.head(1):
            old = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = components(old.union(extra), folder, f"components-{turn}")

    # The first document of each component, then the component of each class.
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min(order("node_id", "node")).alias("head"))
    labelled = rooted.join(heads, "root").select(F.col("digest").alias("d"), "head")
    joined = made.select("row", "doc_id", "n_shingles", "digest").join(labelled, F.col("digest") == F.col("d"), "left")
    alone = F.col("digest").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    kept = F.col("doc_id").eqNullSafe(component) if row is None else alone | (F.col("row") == F.col("head.row"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *([] if row is None else ["row"]))


def wanted(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts of the nodes that occur in pairs."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    return texts.join(ids, "node", "left_semi")


def op7_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
